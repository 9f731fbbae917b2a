"""Command line: `python -m quadrille THEME TYPE --root LAKE --geom-filter-bbox ...`."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from quadrille.errors import BadParameter
from quadrille.plans.predicate import parsed_all
from quadrille.sources import regions, sink

VERSION = "0.1.0"
#: What each region option is parsed with.
REGIONS = {
    "bbox": regions.from_bbox,
    "file": regions.from_file,
    "geocode": regions.geocode,
    "geojson": regions.from_geojson,
    "index-geohash": regions.from_geohash,
    "index-h3": regions.from_h3,
    "index-s2": regions.from_s2,
    "wkt": regions.from_wkt,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quadrille", description="Extracts features of a lake to a GeoParquet file.")
    p.add_argument("theme", nargs="?")
    p.add_argument("type", nargs="?")
    p.add_argument("--root", help="the lake's root folder")
    p.add_argument("--release-version", "--release", dest="release")
    for name in REGIONS:
        p.add_argument(f"--geom-filter-{name}")
    p.add_argument("--filter", "--pyarrow-filter", dest="filters", action="append", default=[])
    p.add_argument("--compression", default=sink.COMPRESSION)
    p.add_argument("--compression-level", type=int, default=sink.LEVEL)
    p.add_argument("--row-group-size", type=int, default=sink.ROW_GROUP)
    p.add_argument("--output", "-o")
    p.add_argument("--ignore-cache", "--no-cache", action="store_true")
    p.add_argument("--sort", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--working-directory", "--work-dir", default="files")
    p.add_argument("--silent", action="store_true")
    p.add_argument("--transient", action="store_true")
    p.add_argument("--show-release-versions", action="store_true")
    p.add_argument("--show-theme-type-pairs", action="store_true")
    p.add_argument("--version", "-v", action="version", version=VERSION)
    return p


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    """0, or 2 with a message for a wrong call."""
    p = parser()
    a = p.parse_args(argv)
    try:
        if a.silent and a.transient:
            raise BadParameter("--silent and --transient exclude each other")
        if not a.root:
            raise BadParameter("--root is needed")
        given = [(n, v) for n in REGIONS if (v := getattr(a, f"geom_filter_{n.replace('-', '_')}"))]
        listing = a.show_release_versions or a.show_theme_type_pairs
        if not listing and (not a.theme or not a.type):
            raise BadParameter("theme and type are needed")
        if not listing and len(given) != 1:
            raise BadParameter("exactly one --geom-filter option is needed" if not given else "only one --geom-filter option can be given")
        region = None if listing else REGIONS[given[0][0]](given[0][1])
        where = parsed_all(a.filters)
        from quadrille import api

        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("quadrille").getOrCreate()
        api.configure(spark, a.root)
        if a.show_release_versions:
            print("\n".join(api.get_available_release_versions()))
            return 0
        pairs = api.get_available_theme_type_pairs(a.release)
        if a.show_theme_type_pairs:
            print("\n".join(f"{t}|{u}" for t, u in pairs))
            return 0
        if (a.theme, a.type) not in pairs:
            raise BadParameter(f"no {a.theme}/{a.type} in this release")
        path = api.download_data(a.theme, a.type, region, a.release, where, None, a.output, a.compression, a.compression_level, a.row_group_size, a.ignore_cache, a.working_directory, a.sort)
    except (BadParameter, NotImplementedError) as e:
        print(f"{p.prog}: {e}", file=sys.stderr)
        return 2
    print(path)
    return 0
