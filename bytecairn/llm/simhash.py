"""SimHash near-dedup with deletion-variant signatures.

Fingerprints of word shingles link when few enough of their bits differ. A fingerprint is cut into segments, and
every fingerprint is indexed under each segment with each one bit left out: two of them meet under a segment in which at most
one bit differs. Equal signatures meet in one sorted partition, where every candidate is verified by its Hamming
distance over the whole fingerprint. Small signature groups are compared outright; in large and dense ones a leader links
its neighbourhood, and two clusters are compared only where their leaders' distance leaves room for a link, so a
group of n near copies costs about n and yields n - 1 links. Every component of links survives; copies are not
expanded into pairs. Components come from alternating large-star and small-star steps.

A ``Scheme`` says how wide fingerprints are, how they are cut and how far links reach:

- ``EXACT``: 64 bits in three segments, 4 differing bits. Of four differing bits some segment has at most one, so no
  link is missed.
- ``NEAR``: 128 bits in eight segments, for five-word shingles of a similarity (Jaccard) of 0.8 or more. Such texts differ in 19 bits on average
  and are linked up to 26. A pair at 0.8 is met with a probability of about 0.9, one at 0.9 nearly always; texts
  below about 0.5 are not linked, but short ones between that and 0.8 may be, since their fingerprints are coarse.

The work a signature group takes grows with the square of the unrelated fingerprints it holds (n / 2^20 of n under
``EXACT``, n / 2^15 under ``NEAR``), which is the method's own limit: beyond some ten million documents ``NEAR`` wants wider segments and more of
them. Memory holds one signature group's fingerprints; texts that are equal or normalise alike are one fingerprint.

Defined cases: null and empty texts have no words and fingerprint zero, linked like any other; a text of
fewer words than a shingle is one shingle; a null doc_id takes part but names no component unless it is
alone (then component_id is null); repeated rows keep one result row each; extra columns, whatever their names,
pass through ``keep_one_per_component``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, hot_group_aggregate, in_parallel, materialise, packed, spread, table, unpacked

SHINGLE = 4
SEED = 42


@dataclass(frozen=True)
class Scheme:
    words: int
    """64-bit words of a fingerprint; the hash of word k has seed SEED + k."""
    segments: tuple[tuple[int, int], ...]
    """First bit and width of each, none across words."""
    distance: int
    small: int
    """Signature groups up to this size are compared pair by pair."""


EXACT = Scheme(1, ((0, 21), (21, 21), (42, 22)), 4, 32)
NEAR = Scheme(2, tuple((16 * k, 16) for k in range(8)), 26, 512)
#: A group of more members than this that has over two pairs a member is spanned from leaders instead of compared outright.
DENSE = 16
#: Ids that lose a row are joined by broadcast up to this many (some 20 bytes each), by shuffle beyond it.
BROADCAST_IDS = 1_000_000
#: Shingle of the pipeline's stage.
NEAR_SHINGLE = 5


def simhash(text: str | None, shingle: int = SHINGLE, words: int = 1) -> tuple[int, ...]:
    """Fingerprint as unsigned 64-bit integers."""
    tokens = text.encode("utf-8").lower().split() if text else []
    if not tokens:
        return (0,) * words
    joined = b" ".join(tokens)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in tokens)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = list(zip(starts, ends[shingle - 1 :])) if len(tokens) >= shingle else [(0, len(joined))]
    digest, out = xxhash.xxh64_intdigest, []
    for seed in range(SEED, SEED + words):
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(spans), 1 << 15):
            block = np.array([digest(joined[a:b], seed) for a, b in spans[at : at + (1 << 15)]], dtype=">u8")
            counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * counts > len(spans)).tobytes(), "big"))
    return tuple(out)


def simhash64(text: str | None, shingle: int = SHINGLE) -> int:
    return simhash(text, shingle)[0]


def _columns(scheme: Scheme, prefix: str) -> list[str]:
    return [f"{prefix}{k}" for k in range(scheme.words)]


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, scheme: Scheme = EXACT) -> DataFrame:
    """doc_id and the fingerprint's words (signed longs f0, ...) of every row."""

    @F.pandas_udf("array<long>")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.array([simhash(t, shingle, scheme.words) for t in texts], dtype=np.uint64).view(np.int64)))

    made = in_parallel(documents.select("doc_id", "text")).select("doc_id", fp("text").alias("fp"))
    return made.select("doc_id", *[F.col("fp")[k].alias(c) for k, c in enumerate(_columns(scheme, "f"))])


def _masks(scheme: Scheme) -> list[int]:
    """For every bit, its segment (within its word) without that bit, as a signed 64-bit literal."""
    out = []
    for first, width in scheme.segments:
        segment = ((1 << width) - 1) << first % 64
        out += [segment & ~(1 << b % 64) for b in range(first, first + width)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def signatures(distinct: DataFrame, scheme: Scheme) -> DataFrame:
    """Every fingerprint under each segment with one bit left out."""
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(scheme)])
    words = _columns(scheme, "f")
    own = F.col("f0")
    for k, c in enumerate(words[1:], 1):
        own = F.when(F.col("bit") >= 64 * k, F.col(c)).otherwise(own)
    return distinct.select(*words, F.posexplode(masks).alias("bit", "mask")).select(F.col("bit").cast("byte").alias("bit"), own.bitwiseAND(F.col("mask")).alias("sig"), *words)


def _distance(x: np.ndarray) -> np.ndarray:
    """Bits set over all words of each row."""
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def _first_shared_bit(x: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The lowest wildcard bit under which two fingerprints of exclusive-or ``x`` (n, words) meet."""
    none = 64 * scheme.words
    best = np.full(len(x), none, dtype=np.int64)
    for first, width in scheme.segments:
        part = (x[:, first // 64] >> np.uint64(first % 64)) & np.uint64((1 << width) - 1)
        ones = np.bitwise_count(part)
        at = np.where(ones == 0, first, np.where(ones == 1, first + np.bitwise_count(part - np.uint64(1) & ~part), none))
        best = np.minimum(best, at)
    return best


Links = list[tuple[np.ndarray, np.ndarray]]


def _links_of_small(bit: np.ndarray, group: np.ndarray, fp: np.ndarray, scheme: Scheme) -> tuple[Links, np.ndarray]:
    """All verified pairs within groups, each under its first shared signature only; and the groups that are left out, since they have far more pairs than members."""
    first, second = [], []
    for d in range(1, scheme.small):
        same = np.flatnonzero(group[d:] == group[:-d])
        if not len(same):
            break
        same = same[_distance(fp[same] ^ fp[same + d]) <= scheme.distance]
        first.append(same)
        second.append(same + d)
    if not first:
        return [], np.zeros(0, np.int64)
    a, b = np.concatenate(first), np.concatenate(second)
    size, pairs = np.bincount(group), np.bincount(group[a], minlength=int(group.max()) + 1)
    dense = (size > DENSE) & (pairs > 2 * size)
    kept = ~dense[group[a]]
    a, b = a[kept], b[kept]
    own = _first_shared_bit(fp[a] ^ fp[b], scheme) == bit[a]
    return [(fp[a[own]], fp[b[own]])], np.flatnonzero(dense)


def _links_of_large(fp: np.ndarray, scheme: Scheme = EXACT) -> Links:
    """A spanning set of the links within one group: every component of its links stays connected."""
    cluster, leaders, parent, out = np.full(len(fp), -1), [], [], []

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    at = 0
    while at < len(fp):
        if cluster[at] >= 0:
            at += 1
            continue
        c, lead = len(leaders), fp[at]
        near = np.flatnonzero(_distance(fp ^ lead) <= scheme.distance)
        fresh = near[cluster[near] < 0]
        leaders.append(lead)
        parent.append(c)
        for other in np.unique(cluster[near[cluster[near] >= 0]]):
            if root(int(other)) != root(c):
                witness = near[cluster[near] == other][:1]
                out.append((lead[None], fp[witness]))
                parent[root(int(other))] = root(c)
        cluster[fresh] = c
        out.append((np.tile(lead, (len(fresh) - 1, 1)), fp[fresh[fresh != at]]))
    lead = np.array(leaders, dtype=np.uint64)
    order = np.argsort(cluster, kind="stable")
    bounds = np.searchsorted(cluster[order], np.arange(len(leaders) + 1))
    members = [fp[order[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]
    for c in range(len(leaders)):
        for o in np.flatnonzero(_distance(lead[c + 1 :] ^ lead[c]) <= 3 * scheme.distance) + c + 1:
            if root(c) == root(int(o)):
                continue
            for a in members[c]:
                hit = np.flatnonzero(_distance(members[o] ^ a) <= scheme.distance)
                if len(hit):
                    out.append((a[None], members[o][hit[:1]]))
                    parent[root(int(o))] = root(c)
                    break
    return out


def link_pairs(distinct: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """Verified links that keep every component of the link relation connected: the words of both fingerprints (a0, ..., b0, ...)."""
    names = _columns(scheme, "f")

    def links(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        bit, sig = pdf["bit"].to_numpy().astype(np.int64), pdf["sig"].to_numpy()
        fp = np.ascontiguousarray(pdf[names].to_numpy().astype(np.int64)).view(np.uint64)
        new = np.ones(len(fp), dtype=bool)
        new[1:] = (bit[1:] != bit[:-1]) | (sig[1:] != sig[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fp)))
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat((sizes > 1) & (sizes <= scheme.small), sizes)
        found, dense = _links_of_small(bit[small], group[small], fp[small], scheme)
        for g in [*np.flatnonzero(sizes > scheme.small), *dense]:
            # a link that a lower bit's group has too is left to that: there its ends are connected
            for a, b in _links_of_large(fp[starts[g] : starts[g] + sizes[g]], scheme):
                own = _first_shared_bit(a ^ b, scheme) == bit[starts[g]]
                found.append((a[own], b[own]))
        for a, b in found:
            if len(a):
                both = np.hstack([a, b]).view(np.int64)
                yield pd.DataFrame(both, columns=_columns(scheme, "a") + _columns(scheme, "b"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by signature; a group that batches cut is held until it is whole."""
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = (pdf["bit"] == pdf["bit"].iloc[-1]) & (pdf["sig"] == pdf["sig"].iloc[-1])
            begin = int(len(pdf) - last.to_numpy()[::-1].argmin()) if not last.all() else 0
            if begin:
                yield from links(pd.concat([*held, pdf.iloc[:begin]], ignore_index=True))
                held = [pdf.iloc[begin:]]
            elif held and (held[0]["bit"].iloc[0], held[0]["sig"].iloc[0]) != (pdf["bit"].iloc[0], pdf["sig"].iloc[0]):
                yield from links(pd.concat(held, ignore_index=True))
                held = [pdf]
            else:
                held.append(pdf)
        if held:
            yield from links(pd.concat(held, ignore_index=True))

    dealt = signatures(distinct, scheme).repartition("bit", "sig").sortWithinPartitions("bit", "sig", *names)
    out = _columns(scheme, "a") + _columns(scheme, "b")
    differ = " OR ".join(f"a{k} <> b{k}" for k in range(scheme.words))
    return dealt.mapInPandas(match, ", ".join(f"{c} long" for c in out)).where(differ).distinct()


def _node(scheme: Scheme, prefix: str) -> Column:
    """A fingerprint as one value: the long itself, or a hash of several (of a billion fingerprints two share one with a chance of 3 %)."""
    words = _columns(scheme, prefix)
    return F.col(words[0]) if scheme.words == 1 else F.xxhash64(*words)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over undirected edges (u, v)."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = hot_group_aggregate(both, ["u"], ["v"], {"_m": (F.min("v"), "min")}).withColumn("m", F.least("_m", "u"))
    if large:
        out = least.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = least.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and its component's least node, for every node that has a link."""
    edges = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    facts = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0))).first()
    state = facts(edges)
    while state[0]:
        edges = materialise(_star(_star(edges, large=True), large=False))
        if (now := facts(edges)) == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, scheme: Scheme = EXACT) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id reachable)."""
    with bounded_batches(documents.sparkSession):
        docs = materialise(fingerprints(documents, shingle, scheme).withColumn("fp", _node(scheme, "f")).withColumn("_salt", spread(F.col("doc_id"))))
    words = _columns(scheme, "f")
    by_salt = docs.groupBy("fp", *words, "_salt").agg(F.min("doc_id").alias("_first"))
    distinct = materialise(by_salt.groupBy("fp", *words).agg(F.min("_first").alias("_first")))
    roots = components(link_pairs(distinct.select(*words), scheme).select(_node(scheme, "a").alias("a"), _node(scheme, "b").alias("b")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "_first")
    named = hot_group_aggregate(rooted, ["root"], ["fp"], {"component_id": (F.min("_first"), "min")}).select(F.col("fp").alias("_fp"), "component_id")
    # a fingerprint that very many documents share meets its component once per salt
    lookup = by_salt.select("fp", "_salt").join(named, F.col("fp") == F.col("_fp"), "inner").select("_fp", F.col("_salt").alias("_s"), "component_id")
    joined = docs.join(lookup, (F.col("fp") == F.col("_fp")) & (F.col("_salt") == F.col("_s")), "inner")
    shown = F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in words])
    return joined.select("doc_id", shown.alias("fingerprint"), "component_id")


def keep_one_per_component(documents: DataFrame, shingle: int = SHINGLE, scheme: Scheme = EXACT) -> DataFrame:
    """The row of the smallest doc_id of every component; a row with a null doc_id stays only if its whole component has none.

    Rows that repeat the kept doc_id stay once: that of the lowest hash. Only ids that lose a row are joined, so where they are few,
    the documents are not shuffled.
    """
    result = near_duplicates(documents.select("doc_id", "text"), shingle, scheme)
    stays = F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id")))
    per_id = result.groupBy("doc_id").agg(stays.alias("_stays"), F.count(F.lit(1)).alias("_rows"))
    losing = materialise(per_id.where(~F.col("_stays") | ((F.col("_rows") > 1) & F.col("doc_id").isNotNull())).select(F.col("doc_id").alias("_id"), "_stays"))
    rows = packed(documents, F.col("doc_id").alias("_key"))
    few = losing.count() <= BROADCAST_IDS
    losing = F.broadcast(losing) if few else losing
    whole = rows.join(losing, F.col("_key").eqNullSafe(F.col("_id")), "left_anti")
    repeated = losing.where("_stays")
    if repeated.isEmpty():
        return unpacked(whole, documents.columns)
    repeated = F.broadcast(repeated) if few else repeated
    first = Window.partitionBy("_key").orderBy(F.xxhash64("row"))
    once = rows.join(repeated, F.col("_key") == F.col("_id"), "left_semi").withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    return unpacked(whole.unionByName(once), documents.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components over the whole ``documents`` table."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
