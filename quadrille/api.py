"""Ready-made calls: a region and a theme/type in, a GeoParquet file or a frame out.

`configure` names the lake once.  The lazy form behind every call is
`features` (an extract as a DataFrame) and `wide_features` (a wide form).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.geometry import Geometry
from quadrille.operators import wide as W
from quadrille.operators.extract import extract
from quadrille.operators.order import spatially_sorted
from quadrille.plans.predicate import Predicate
from quadrille.sources import cache, index, names, sink
from quadrille.sources.grouped import grouped_extract
from quadrille.sources.lake import Lake
from quadrille.sources.shared import removed

Pair = tuple[str, str]


@dataclass
class Settings:
    """The lake, and where indexes, taxonomies and results lie; None: no index, no taxonomy."""

    spark: SparkSession
    root: str
    index_root: str | None = None
    taxonomy: str | None = None

    @property
    def lake(self) -> Lake:
        return Lake(self.spark, self.root)


_settings: list[Settings] = []


def configure(spark: SparkSession, root: str, index_root: str | None = None, taxonomy: str | None = None) -> None:
    _settings[:] = [Settings(spark, root, index_root, taxonomy)]


def _s() -> Settings:
    if not _settings:
        raise RuntimeError("call configure(spark, root) first")
    return _settings[0]


# Metadata.


def get_available_release_versions() -> list[str]:
    return _s().lake.releases()


def get_newest_release_version() -> str:
    return _s().lake.newest()


def get_available_theme_type_pairs(release: str | None = None) -> list[Pair]:
    return _s().lake.pairs(release)


def clear_release_indexes_cache() -> None:
    if _s().index_root:
        removed(_s().spark, _s().index_root)


# Extracts.


def features(theme: str, type: str, geometry_filter: Geometry | None = None, release: str | None = None, pyarrow_filter: Predicate | None = None, columns_to_download: Sequence[str] | None = None) -> DataFrame:
    """The extract as a lazy DataFrame; with an index, only row groups that can hold the region are read."""
    s = _s()
    whole = s.lake.read(theme, type, release)
    if s.index_root and geometry_filter is not None:
        kept = index.load_release_index(s.lake, s.index_root, theme, type, release, geometry_filter)
        return grouped_extract(whole, [(r.filename, r.row_group) for r in kept.collect()], geometry_filter, pyarrow_filter, columns_to_download)
    return extract(whole, geometry_filter, pyarrow_filter, columns_to_download)


def _listed(pairs: Sequence[Pair], values: Any, what: str) -> list:
    """One value for each pair; a list has to be as long as the pairs."""
    if values is None:
        return [None] * len(pairs)
    if len(values) != len(pairs):
        raise ValueError(f"{what} has {len(values)} entries for {len(pairs)} pairs")
    return list(values)


def download_data(theme: str, type: str, geometry_filter: Geometry, release: str | None = None, pyarrow_filter: Predicate | None = None, columns_to_download: Sequence[str] | None = None, result_file_path: str | Path | None = None, compression: str = sink.COMPRESSION, compression_level: int = sink.LEVEL, row_group_size: int = sink.ROW_GROUP, ignore_cache: bool = False, working_directory: str | Path = "files", sort_result: bool = True, verbosity_mode: str = "transient", max_workers: int | None = None) -> Path:
    """Writes an extract to one GeoParquet file, unless the file is there already; returns its path.

    verbosity_mode and max_workers are accepted for callers that pass them; Spark schedules and reports.
    """
    release = _s().lake.resolved(release)
    given = (compression, compression_level, row_group_size)
    output = () if given == (sink.COMPRESSION, sink.LEVEL, sink.ROW_GROUP) else given
    path = Path(result_file_path) if result_file_path else Path(working_directory) / cache.extract_name(release, theme, type, geometry_filter, pyarrow_filter, columns_to_download, sort_result, output)
    if ignore_cache or not path.exists():
        df = features(theme, type, geometry_filter, release, pyarrow_filter, columns_to_download)
        kept = df.columns
        if sort_result and "bbox" not in kept and "bbox" in _s().lake.read(theme, type, release).columns:
            df = features(theme, type, geometry_filter, release, pyarrow_filter, [*kept, "bbox"])  # the order needs it
        sink.write_geoparquet(df, str(path), geometry_filter.bounds, sort_result, *given, kept)
    return path


def download_data_for_multiple_types(theme_type_pairs: Sequence[Pair], geometry_filter: Geometry, release: str | None = None, pyarrow_filter: Sequence | None = None, columns_to_download: Sequence | None = None, **writing: Any) -> list[Path]:
    """A file for each pair; pairs whose file is there are not read again."""
    filters, columns = _listed(theme_type_pairs, pyarrow_filter, "pyarrow_filter"), _listed(theme_type_pairs, columns_to_download, "columns_to_download")
    return [download_data(t, u, geometry_filter, release, f, c, **writing) for (t, u), f, c in zip(theme_type_pairs, filters, columns, strict=True)]


convert_geometry_to_parquet = download_data
convert_geometry_to_parquet_for_multiple_types = download_data_for_multiple_types


def _frame(path: Path):
    return sink.to_frame(_s().spark.read.parquet(f"file://{path.resolve()}"))


def convert_geometry_to_geodataframe(*args: Any, **kwargs: Any):
    return _frame(download_data(*args, **kwargs))


def convert_geometry_to_geodataframe_for_multiple_types(*args: Any, **kwargs: Any) -> list:
    return [_frame(p) for p in download_data_for_multiple_types(*args, **kwargs)]


def convert_bounding_box_to_parquet(theme: str, type: str, bbox: tuple[float, float, float, float], *args: Any, **kwargs: Any) -> Path:
    return download_data(theme, type, Geometry.box(*bbox), *args, **kwargs)


def convert_bounding_box_to_parquet_for_multiple_types(theme_type_pairs: Sequence[Pair], bbox: tuple[float, float, float, float], *args: Any, **kwargs: Any) -> list[Path]:
    return download_data_for_multiple_types(theme_type_pairs, Geometry.box(*bbox), *args, **kwargs)


def convert_bounding_box_to_geodataframe(*args: Any, **kwargs: Any):
    return _frame(convert_bounding_box_to_parquet(*args, **kwargs))


def convert_bounding_box_to_geodataframe_for_multiple_types(*args: Any, **kwargs: Any) -> list:
    return [_frame(p) for p in convert_bounding_box_to_parquet_for_multiple_types(*args, **kwargs)]


# Wide forms.


def _definition(pair: Pair, release: str) -> DataFrame:
    """All paths of a table in a release, from the names index if there is a place for one."""
    s = _s()
    if s.index_root is None:
        return names.all_paths(s.lake, pair, release, s.taxonomy)
    names.generate_names_index(s.lake, s.index_root, release, s.taxonomy)
    return names.load_names_index(s.spark, s.index_root, pair, release)


def wide_features(theme_type_pairs: Sequence[Pair], geometry_filter: Geometry | None = None, release: str | None = None, pyarrow_filter: Sequence | None = None, hierarchy_depth: int | None | Sequence[int | None] = None, include_all_possible_columns: bool = True, places_use_primary_category_only: bool = False, places_minimal_confidence: float = 0.75) -> W.Packed:
    """The packed wide form of one or more tables."""
    s = _s()
    release = s.lake.resolved(release)
    levels = W.hierarchies(release)
    filters = _listed(theme_type_pairs, pyarrow_filter, "pyarrow_filter")
    depths = _listed(theme_type_pairs, hierarchy_depth, "hierarchy_depth") if isinstance(hierarchy_depth, (list, tuple)) else [hierarchy_depth] * len(theme_type_pairs)
    parts = []
    for pair, where, depth in zip(theme_type_pairs, filters, depths, strict=True):
        rows = features(*pair, geometry_filter, release, where)
        kept = [c for c in ("id", "geometry", "bbox") if c in rows.columns]
        if pair == W.PLACES:
            primary = names.primary_name(release)
            definition = _definition(pair, release)
            if not include_all_possible_columns:
                shown = rows.where((F.col("confidence") >= places_minimal_confidence) & ~F.isnan("confidence"))
                definition = definition.join(W.observed_categories(shown, primary, places_use_primary_category_only), "category", "left_semi")
            parts.append(W.places(rows, definition, depth, places_use_primary_category_only, places_minimal_confidence, kept, primary, pair))
        else:
            parts.append(W.standard(rows, pair, depth, _definition(pair, release) if include_all_possible_columns else None, kept, levels[pair]))
    return W.united(parts)


def get_all_possible_column_names(release: str | None = None, theme: str | None = None, type: str | None = None, hierarchy_depth: int | None | Sequence[int | None] = None) -> list[str]:
    """The names that a wide form can have, of one pair or of all, sorted."""
    if (theme is None) != (type is None):
        raise ValueError("theme and type go together")
    release = _s().lake.resolved(release)
    levels = W.hierarchies(release)
    pairs = [(theme, type)] if theme is not None else [p for p in _s().lake.pairs(release) if p in levels]
    depths = hierarchy_depth if isinstance(hierarchy_depth, (list, tuple)) else [hierarchy_depth] * len(pairs)
    found: set[str] = set()
    for pair, depth in zip(pairs, depths, strict=True):
        own = levels[pair][: W.checked_depth(depth, len(levels[pair]))]
        definition = _definition(pair, release)
        own = [c for c in own if c in definition.columns]
        found |= set(W.column_names(W.definitions(definition, pair, own))) if own else {"|".join(pair)}
    return sorted(found)


def convert_geometry_to_wide_form_parquet_for_multiple_types(theme_type_pairs: Sequence[Pair], geometry_filter: Geometry, release: str | None = None, pyarrow_filter: Sequence | None = None, hierarchy_depth: Any = None, include_all_possible_columns: bool = True, result_file_path: str | Path | None = None, compression: str = sink.COMPRESSION, compression_level: int = sink.LEVEL, row_group_size: int = sink.ROW_GROUP, ignore_cache: bool = False, working_directory: str | Path = "files", sort_result: bool = True, verbosity_mode: str = "transient", max_workers: int | None = None, **places: Any) -> Path:
    """Writes a wide form to one GeoParquet file: id, geometry and the sorted names; returns its path."""
    release = _s().lake.resolved(release)
    depths = list(hierarchy_depth) if isinstance(hierarchy_depth, (list, tuple)) else [hierarchy_depth] * len(theme_type_pairs)
    filters = _listed(theme_type_pairs, pyarrow_filter, "pyarrow_filter")
    options = dict(places) | ({} if (compression, compression_level, row_group_size) == (sink.COMPRESSION, sink.LEVEL, sink.ROW_GROUP) else {"output": (compression, compression_level, row_group_size)})
    path = Path(result_file_path) if result_file_path else Path(working_directory) / cache.wide_name(release, theme_type_pairs, geometry_filter, filters, depths, options, not include_all_possible_columns, sort_result)
    if ignore_cache or not path.exists():
        packed = wide_features(theme_type_pairs, geometry_filter, release, pyarrow_filter, hierarchy_depth, include_all_possible_columns, **places)
        # The sort moves packed rows; the boolean columns are made behind it.
        rows = packed.rows
        if sort_result and "bbox" in rows.columns:
            rows = spatially_sorted(rows, geometry_filter.bounds)
        table = W.unpacked(rows.drop("bbox"), packed.names)
        sink.write_geoparquet(table, str(path), sort=False, compression=compression, level=compression_level, row_group_size=row_group_size)
    return path


def convert_geometry_to_wide_form_parquet_for_all_types(geometry_filter: Geometry, release: str | None = None, **kwargs: Any) -> Path:
    release = _s().lake.resolved(release)
    there = set(_s().lake.pairs(release))
    return convert_geometry_to_wide_form_parquet_for_multiple_types([p for p in W.hierarchies(release) if p in there], geometry_filter, release, **kwargs)


def convert_geometry_to_wide_form_parquet(theme: str, type: str, geometry_filter: Geometry, release: str | None = None, pyarrow_filter: Predicate | None = None, hierarchy_depth: int | None = None, **kwargs: Any) -> Path:
    return convert_geometry_to_wide_form_parquet_for_multiple_types([(theme, type)], geometry_filter, release, None if pyarrow_filter is None else [pyarrow_filter], [hierarchy_depth], **kwargs)


def convert_geometry_to_wide_form_geodataframe(*args: Any, **kwargs: Any):
    return _frame(convert_geometry_to_wide_form_parquet(*args, **kwargs))


def convert_geometry_to_wide_form_geodataframe_for_all_types(*args: Any, **kwargs: Any):
    return _frame(convert_geometry_to_wide_form_parquet_for_all_types(*args, **kwargs))


def convert_geometry_to_wide_form_geodataframe_for_multiple_types(*args: Any, **kwargs: Any):
    return _frame(convert_geometry_to_wide_form_parquet_for_multiple_types(*args, **kwargs))


def convert_bounding_box_to_wide_form_parquet(theme: str, type: str, bbox: tuple[float, float, float, float], *args: Any, **kwargs: Any) -> Path:
    return convert_geometry_to_wide_form_parquet(theme, type, Geometry.box(*bbox), *args, **kwargs)


def convert_bounding_box_to_wide_form_parquet_for_all_types(bbox: tuple[float, float, float, float], *args: Any, **kwargs: Any) -> Path:
    return convert_geometry_to_wide_form_parquet_for_all_types(Geometry.box(*bbox), *args, **kwargs)


def convert_bounding_box_to_wide_form_parquet_for_multiple_types(theme_type_pairs: Sequence[Pair], bbox: tuple[float, float, float, float], *args: Any, **kwargs: Any) -> Path:
    return convert_geometry_to_wide_form_parquet_for_multiple_types(theme_type_pairs, Geometry.box(*bbox), *args, **kwargs)


def convert_bounding_box_to_wide_form_geodataframe(*args: Any, **kwargs: Any):
    return _frame(convert_bounding_box_to_wide_form_parquet(*args, **kwargs))


def convert_bounding_box_to_wide_form_geodataframe_for_all_types(*args: Any, **kwargs: Any):
    return _frame(convert_bounding_box_to_wide_form_parquet_for_all_types(*args, **kwargs))


def convert_bounding_box_to_wide_form_geodataframe_for_multiple_types(*args: Any, **kwargs: Any):
    return _frame(convert_bounding_box_to_wide_form_parquet_for_multiple_types(*args, **kwargs))
