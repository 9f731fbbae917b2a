"""URL filtering by a Bloom filter cascade, with DataFrame functions only.

Level 1 encodes the listed keys.  Level 2 encodes the keys of the corpus that
level 1 passes although they are not listed, level 3 the listed keys that
level 2 passes, and so on until a level has no false positive.  As the corpus's
complete key universe takes part in the build, the first level that rejects a
key tells exactly whether it is listed: an odd level says no, an even one yes.
The bits are a literal in the scan's expressions, so judging needs no join.

Keys are hosts; a url carries its host and every parent domain, and is listed
if any of them is.  The bits' size is computed from counted keys before any
is built.  A plan carries MAX_BITS at most: a longer list's keys are dealt to
shares by a hash, each share gets a cascade of its own, and the urls are judged
in one pass for each share, whose plan carries that share's bits alone.  Passes
grow with the list (one for each 8 MB of bits); none of them joins.

A rule's path is what stands behind its host, its `/` included, so `net/` fits
`http://x.net/` and not `http://x.net`, whose path is empty.

Defined results: a url that is null or has no `://` has empty host and path
and the verdict allow; null keys in the list are ignored; an empty list or
table gives allow, or no row; repeated rows are judged one by one; of rules of
one length the later by text wins; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.workspace import stored

#: Bits of all levels together that may go out with a plan: 8 MB; a share isn't made for fewer than LEAST_BITS.
MAX_BITS, LEAST_BITS = 1 << 26, 1 << 12
#: Seeds the hash that deals keys to shares; levels' seeds are small.
DEAL = 1 << 40
#: Bits in one of Spark's bitmap chunks (a fixed value of bitmap_construct_agg).
CHUNK = 32768

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From behind the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_behind(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_behind(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _behind(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def domains(host: Column) -> Column:
    """The host and its parent domains, from the longest; none of an empty host."""
    labels = F.split(host, r"\.", -1)
    whole = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(whole)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its seed, hash count, size and bits."""

    seed: int
    hashes: int
    bits: int
    data: bytes = field(repr=False)

    def passes(self, key: Column) -> Column:
        """The level's bits stand once in the expression, however many hashes it has."""
        return F.forall(F.array(*positions(key, self.seed, self.hashes, self.bits)), self._bit)

    def _bit(self, position: Column) -> Column:
        byte = F.substring(F.lit(self.data), (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        # Positions within a byte count from its lowest bit.
        return F.call_function("getbit", value, (position % 8).cast("int")) == 1


def positions(key: Column, seed: int, hashes: int, bits: int) -> list[Column]:
    """Bit positions, by a hash of its own each."""
    return [F.pmod(F.xxhash64(F.lit(64 * seed + i), key), F.lit(bits)) for i in range(hashes)]


def sized(n: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) for n keys at a false-positive rate."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(n, 1) * math.log(2))) if n else 1


@dataclass(frozen=True)
class Cascade:
    """Exact membership for the keys of the universe it was built over."""

    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        verdict = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            verdict = F.when(~self.levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(verdict)
        return verdict


class TooLarge(ValueError):
    """The cascade would need more than the allowed bits."""


@dataclass(frozen=True)
class Share:
    """The keys whose hash leaves this remainder."""

    modulus: int
    remainder: int

    def has(self, key: Column) -> Column:
        return F.lit(True) if self.modulus == 1 else _dealt(key, self.modulus) == self.remainder

    def halves(self) -> tuple[Share, Share]:
        return Share(2 * self.modulus, self.remainder), Share(2 * self.modulus, self.remainder + self.modulus)


def _dealt(key: Column, modulus: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(DEAL), key), F.lit(modulus))


def shares(universe: DataFrame, max_bits: int = MAX_BITS) -> Iterator[tuple[Share, Cascade]]:
    """Cascades of max_bits each, LEAST_BITS at least, that together cover `universe` (key, listed); one where that is enough.

    They come one at a time, so the driver holds the bits of one.  A share that
    turns out too large is split by the next bit of its keys' hash.
    """
    max_bits = max(max_bits, LEAST_BITS)
    known = stored(universe.select("key", "listed"), "key-universe")
    sizes = known.agg(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("other")).first()
    modulus = max(1, math.ceil(expected_bits(sizes.listed, sizes.other) / max_bits))
    if modulus > 1:  # in order of shares, so that a share's scan skips the row groups of others
        dealt = known.withColumn("share", _dealt(F.col("key"), modulus))
        known = stored(dealt.repartitionByRange("share", "key").sortWithinPartitions("share"), "key-shares")
    left = [Share(modulus, r) for r in range(modulus)]
    while left:
        share = left.pop()
        own = known.filter((F.col("share") == share.remainder % modulus) & share.has(F.col("key"))) if modulus > 1 else known.filter(share.has(F.col("key")))
        try:
            yield share, _built(own, max_bits)
        except TooLarge:
            left += share.halves()


def _first_rate(listed: int, other: int) -> float:
    return min(0.5, max(1e-6, listed * math.sqrt(0.5) / max(other, 1)))


def expected_bits(listed: int, other: int) -> int:
    """The bits that a cascade of this many keys is expected to need: each later level has half the keys of the one two before."""
    rate = _first_rate(listed, other)
    later = 2 * (other * rate + listed / 2) / math.log(2)
    return math.ceil(sized(listed, rate)[0] + later) if listed else 0


def build_cascade(universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade:
    """One cascade over `universe` (key, listed): each key once, each with whether it is listed."""
    return _built(stored(universe.select("key", "listed"), "key-universe"), max_bits)


def _built(known: DataFrame, max_bits: int) -> Cascade:
    sizes = known.agg(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("other")).first()
    levels: list[Level] = []
    left, n, other = known.filter("listed"), sizes.listed, sizes.other
    used = 0
    while n:
        bits, hashes = sized(n, 0.5 if levels else _first_rate(n, other))
        used += bits
        if used > max_bits:
            raise TooLarge(f"{used} bits for {sizes.listed} listed of {sizes.listed + sizes.other} keys")
        levels.append(_level(left, len(levels), hashes, bits))
        # The keys of the other kind that every level of this kind's turn has passed so far.
        wrong = known.filter(F.col("listed") if len(levels) % 2 == 0 else ~F.col("listed"))
        for level in levels:
            wrong = wrong.filter(level.passes(F.col("key")))
        left, n = wrong, wrong.count()
    return Cascade(tuple(levels))


def _level(keys: DataFrame, seed: int, hashes: int, bits: int) -> Level:
    at = F.explode(F.array(*positions(F.col("key"), seed, hashes, bits)))
    chunked = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("chunk"))
    # As many rows as the level has chunks of 32,768 bits, which max_bits bounds.
    rows = chunked.agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits")).collect()
    data = bytearray(-(-bits // CHUNK) * CHUNK // 8)
    for row in rows:
        begin = (row.chunk - 1) * CHUNK // 8
        data[begin : begin + len(row.bits)] = row.bits
    return Level(seed, hashes, bits, bytes(data[: -(-bits // 8)]))


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with the rule's."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule, listed, verdict of every row of `pages` (page_id, url).

    `listed` has the column key: hosts that are blocked with their subdomains.
    """
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = rows.select(F.explode(domains(F.col("host"))).alias("key"), F.lit(False).alias("listed"))
    wanted = listed.filter(F.col("key").isNotNull()).select(F.translate(F.col("key").cast("string"), UPPER, LOWER).alias("key"))
    universe = keys.union(wanted.select("key", F.lit(True))).groupBy("key").agg(F.max("listed").alias("listed"))
    found = rows.withColumn("listed", F.lit(False))
    for share, cascade in shares(universe, max_bits):
        if cascade.levels:
            found = found.withColumn("listed", F.col("listed") | F.exists(domains(F.col("host")), lambda k: share.has(k) & cascade.holds(k)))  # noqa: B023
            if share.modulus > 1:
                found = stored(found, "judged")  # the next plan doesn't carry these bits
    host, path = F.col("host"), F.col("path")
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        rule, ruled = F.when(r.fits(host, path), r.text).otherwise(rule), F.when(r.fits(host, path), r.verdict).otherwise(ruled)
    verdict = F.coalesce(ruled, F.when(F.col("listed"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")
