"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Independent trees branch
the documents: a node picks one of the minwise coordinates by a hash of its own
path, and each of its documents goes to the child of the minwise token it has
there. Nodes of at most ``SMALL`` documents are leaves; larger ones branch
again, down to ``DEPTH``. Within a leaf documents are compared exhaustively by
their minwise sketches, and what may be similar enough is confirmed on the full
sets, read from the whole texts.

Links serve to find the components, so leaves are worked in two turns. In the
first each document is held against the least one of each of its leaves, and its
likeliest partner is confirmed; that settles a clump of copies with one
comparison per copy. In the second, documents of a leaf that are still in
another component than its least one are compared with all of the leaf, in
blocks of ``SMALL``. What is alike by its sketches falls into clusters, and in
these every candidate link between different components is confirmed or refuted
on the full sets, in blocks again. A link between components is lost only where
all trees part its ends. The trees share the 64 coordinates, so over the number
of equal ones that has, at the full depth, a probability of 1.1e-5 at similarity
0.85 and 1.8e-4 at 0.8, and less in leaves nearer to the root.

Defined cases: documents without words, null included, have the empty set and
are linked with nothing. With fewer words than a shingle has, the whole
sequence is the one shingle. Texts alike in their words are one vertex, however
many rows they have. Repeated rows get equal results. Null ids sort after all
others. An empty table gives an empty result. Of a very long text the set of
all shingles is held, 8 bytes each, one text at a time or as many as a cell has.
Columns beside id and text are carried by ``deduplicate`` only, whatever their
names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from curbside.components import connected_components
from curbside.llm.word_hashes import WordHashes
from curbside.llm.words import whole
from curbside.runtime import cut
from curbside.skew import spread_join

#: Minwise coordinates of a document.
COORDINATES = 64
#: Trees, levels of branching, and documents of a leaf that are compared exhaustively.
TREES, DEPTH, SMALL = 24, 4, 512

_U = np.uint64
_rng = np.random.default_rng(20240607)
_MASKS = _rng.integers(0, 2**64, COORDINATES, dtype=np.uint64)
_ODDS = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)


def _words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: what bytes.lower and bytes.split do."""
    return (text or b"").lower().split()


def shingle_set(words: list[bytes], k: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    x = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        x = x * _BASE + h[j : len(h) - k + 1 + j]
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return np.unique(x ^ (x >> _U(29)))


def minwise(s: np.ndarray) -> np.ndarray:
    """The least hash of the set under each coordinate, upper 32 bits."""
    least = np.full(COORDINATES, ~_U(0))
    for at in range(0, len(s), 4096):
        np.minimum(least, ((s[at : at + 4096, None] ^ _MASKS) * _ODDS).min(0), out=least)
    return (least >> _U(32)).astype(np.uint32).view(np.int32)


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            keys, sizes, mins = [], [], []
            for text in batch.column("text"):
                words = _words(text.as_py())
                s = shingle_set(words, k, known)
                keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                sizes.append(len(s))
                mins.append(minwise(s))
            flat = pa.array(np.concatenate(mins) if mins else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(mins) + 1, dtype=np.int32) * COORDINATES), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists], names=["doc_id", "key", "n", "mins"])

    return cut(docs.mapInArrow(work, "doc_id long, key binary, n long, mins array<int>"), "signatures")


def leaves(vertices: DataFrame) -> DataFrame:
    """(node, key, n) of the leaves with two documents or more, n being their number."""

    def child(coordinate, *path):
        return F.xxhash64(*path, F.get(F.col("mins"), coordinate))

    def pick(*path):
        return F.pmod(F.xxhash64(*path), F.lit(COORDINATES)).cast("int")

    root = vertices.select("key", "mins", F.explode(F.sequence(F.lit(1), F.lit(TREES))).alias("tree"))
    # Distinct coordinates at the roots: trees that began alike would not be independent.
    level = root.select("key", child(((F.col("tree") * 37) % COORDINATES).cast("int"), F.col("tree")).alias("node"))
    found = []
    for depth in range(1, DEPTH + 1):
        level = cut(level, "level")
        sizes = level.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        sized = level.join(sizes, "node")
        if depth == DEPTH:
            found.append(sized)
            break
        found.append(sized.filter(F.col("n") <= SMALL))
        level = (
            sized.filter(F.col("n") > SMALL)
            .select("key", "node")
            .join(vertices.select("key", "mins"), "key")
            .select("key", child(pick(F.col("node"), F.lit(depth)), F.col("node"), F.lit(depth)).alias("node"))
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return cut(out.select("node", "key", "n"), "leaves")


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal sketch bytes of each row of a with each row of b."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for c in range(COORDINATES):
        out += a[:, c, None] == b[None, :, c]
    return out


def _sketch(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _with_sketches(vertices: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mins = batch.column("mins").flatten().to_numpy(zero_copy_only=False).view(np.uint32)
            bytes_ = (mins & 255).astype(np.uint8).tobytes()
            rows = [bytes_[i : i + COORDINATES] for i in range(0, len(bytes_), COORDINATES)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(rows, pa.binary())], names=["key", "sketch"])

    return cut(vertices.select("key", "mins").mapInArrow(work, "key binary, sketch binary"), "sketches")


def _first_turn(leaf_rows: DataFrame, sketches: DataFrame, least_equal: int) -> DataFrame:
    """(a, b): each document with its likeliest among the least documents of its leaves."""
    heads = leaf_rows.groupBy("node").agg(F.min("key").alias("a"))
    pairs = leaf_rows.join(heads, "node").filter("key <> a").select("a", F.col("key").alias("b")).distinct()
    both = pairs.join(sketches.select(F.col("key").alias("a"), F.col("sketch").alias("sa")), "a").join(
        sketches.select(F.col("key").alias("b"), F.col("sketch").alias("sb")), "b"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal = (_sketch(batch.column("sa")) == _sketch(batch.column("sb"))).sum(1)
                ok = pa.array(equal >= least_equal)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok), pa.array(equal, pa.int32()).filter(ok)], names=["a", "b", "equal"])

    likely = both.select("a", "b", "sa", "sb").mapInArrow(work, "a binary, b binary, equal int")
    return likely.groupBy("b").agg(F.max(F.struct("equal", "a")).alias("m")).select("m.a", "b")


class _Sets:
    """Disjoint sets of any hashable things."""

    def __init__(self):
        self._up: dict = {}

    def find(self, x):
        while (up := self._up.get(x, x)) != x:
            self._up[x] = self._up.get(up, up)
            x = up
        return x

    def join(self, x, y) -> bool:
        """Whether they were apart."""
        x, y = self.find(x), self.find(y)
        self._up[y] = x
        return x != y


def _headed(named: DataFrame, group: str) -> DataFrame:
    """Rows of the groups of several components, with the group's n rows, its largest component, and the m rows outside that."""
    counts = named.groupBy(group, "component").agg(F.count("*").alias("k"))
    heads = counts.groupBy(group).agg(F.sum("k").alias("n"), F.max(F.struct("k", "component")).alias("h"), F.count("*").alias("parts")).filter("parts > 1")
    return named.join(heads.select(group, "n", (F.col("n") - F.col("h.k")).alias("m"), F.col("h.component").alias("head")), group)


def _dealt(rows: DataFrame, group: str) -> DataFrame:
    """Rows in cells of a group: its n rows as bases in blocks, against the m rows outside its head as probes, in blocks too.

    A cell has some ``SMALL`` rows of each kind, however large its group is.
    """
    blocks, probes = (F.ceil(F.col(c) / SMALL).cast("int") for c in "nm")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    base = rows.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("part", each(probes)).withColumn("probe", F.lit(False))
    probe = rows.filter("component <> head").withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), probes).cast("int")).withColumn("block", each(blocks)).withColumn("probe", F.lit(True))
    return base.unionByName(probe).repartition(group, "block", "part").sortWithinPartitions(group, "block", "part", "probe")


def _candidates(leaf_rows: DataFrame, components: DataFrame, sketches: DataFrame, least_equal: int) -> DataFrame:
    """(u, v): edges that hold together all that is alike by its sketches and in different components.

    A block gives no more edges than it has documents, whatever the number of
    pairs that are alike.
    """
    named = leaf_rows.select("node", "key").join(components.select(F.col("v").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    rows = _headed(cut(named, "named"), "node").join(sketches, "key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ("node", "block", "part")):
            keys, comps, sketch = t["key"].to_pylist(), np.unique(np.asarray(t["component"].to_pylist(), object), return_inverse=True)[1], _sketch(t["sketch"].combine_chunks())
            sets, u, v = _Sets(), [], []
            base = int(np.count_nonzero(~t["probe"].to_numpy()))
            for at in range(base, len(keys), SMALL):
                alike = (_likeness(sketch[at : at + SMALL], sketch[:base]) >= least_equal) & (comps[at : at + SMALL, None] != comps[None, :base])
                for i, j in zip(*(x.tolist() for x in np.nonzero(alike)), strict=True):
                    if sets.join(keys[at + i], keys[j]):
                        u.append(keys[at + i])
                        v.append(keys[j])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    dealt = _dealt(rows, "node").select("node", "block", "part", "probe", "key", "component", "sketch")
    return cut(dealt.mapInArrow(work, "u binary, v binary").distinct(), "candidates")


class _Texts:
    """Rows of a cell with their words, of which the sets are made when they are wanted."""

    def __init__(self, k: int, known: WordHashes):
        self.k, self.known, self.keys, self.components, self.sketches, self.texts = k, known, [], [], [], []

    def add(self, key: bytes, component: bytes, sketch: bytes, text: bytes | None) -> None:
        self.keys.append(key)
        self.components.append(component)
        self.sketches.append(np.frombuffer(sketch, np.uint8))
        self.texts.append(text)

    def set(self, i: int) -> np.ndarray | None:
        """Sorted shingle hashes; none where another text has the same id."""
        if not isinstance(self.texts[i], np.ndarray):
            words = _words(self.texts[i])
            own = hashlib.blake2b(b" ".join(words), digest_size=16).digest() == self.keys[i]
            self.texts[i] = shingle_set(words, self.k, self.known) if own else np.zeros(0, np.uint64)
        return self.texts[i] if len(self.texts[i]) else None


def _settle(candidates: DataFrame, components: DataFrame, docs: DataFrame, vertices: DataFrame, sketches: DataFrame, k: int, percent: int, least_equal: int) -> DataFrame:
    """(u, v): confirmed links that join all components that any link joins.

    Candidates fall into clusters. In a cluster every document outside its
    largest component is held against all, in cells: sketches first, then full
    sets, but for what the links found so far have joined.
    """
    of = connected_components(candidates).select(F.col("v").alias("key"), F.col("component").alias("cluster"))
    of = of.join(components.select(F.col("v").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    rows = _headed(cut(of, "clusters"), "cluster").join(vertices.select("key", F.col("doc_id").alias("__id")), "key").join(sketches, "key")
    rows = docs.join(rows, F.col("doc_id").eqNullSafe(F.col("__id"))).drop("doc_id", "__id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cell, u, v = WordHashes(), None, [], []
        sets, base, probes = _Sets(), _Texts(k, known), _Texts(k, known)

        def hold() -> None:
            if probes.keys and base.keys:
                alike = _likeness(np.stack(probes.sketches), np.stack(base.sketches)) >= least_equal
                for i, j in zip(*(x.tolist() for x in np.nonzero(alike)), strict=True):
                    one, two = probes.components[i], base.components[j]
                    if sets.find(one) == sets.find(two):
                        continue
                    s, t = probes.set(i), base.set(j)
                    if s is None or t is None or 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                        continue
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        sets.join(one, two)
                        u.append(probes.keys[i])
                        v.append(base.keys[j])

        names = ("cluster", "block", "part", "probe", "key", "component", "sketch", "text")
        for batch in batches:
            for *own, probe, key, component, sketch, text in zip(*(batch.column(c) for c in names), strict=True):
                own = tuple(x.as_py() for x in own)
                if own != cell:
                    hold()
                    cell, sets, base, probes = own, _Sets(), _Texts(k, known), _Texts(k, known)
                (probes if probe.as_py() else base).add(key.as_py(), component.as_py(), sketch.as_py(), text.as_py())
                if len(probes.keys) == 64:
                    hold()
                    probes = _Texts(k, known)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])
            u.clear()
            v.clear()
        hold()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    dealt = _dealt(rows, "cluster").select("cluster", "block", "part", "probe", "key", "component", "sketch", "text")
    return cut(dealt.mapInArrow(work, "u binary, v binary"), "links")


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of equal ``by`` from sorted rows; a table is as large as its group, which the caller bounds."""
    held, last = [], None
    for batch in batches:
        marks = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
        at = 0
        for i in range(1, len(marks) + 1):
            if i == len(marks) or marks[i] != marks[at]:
                if held and marks[at] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(at, i - at))
                last, at = marks[at], i
    if held:
        yield pa.Table.from_batches(held)


def confirm(pairs: DataFrame, docs: DataFrame, vertices: DataFrame, k: int, percent: int) -> DataFrame:
    """The (u, v) of ``pairs(a, b)`` whose full sets are similar enough.

    Each pair goes to a group of its ``a``, of ``SMALL`` partners or so; a group
    gets the text of ``a`` and those of the partners, and holds two sets at a time.
    """
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(many, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / SMALL)).cast("int"))
    roles = dealt.select("a", "block", F.lit(0).alias("role"), F.col("a").alias("key")).distinct().unionByName(
        dealt.select("a", "block", F.lit(1).alias("role"), F.col("b").alias("key"))
    )
    wanted = roles.join(vertices.select("key", "doc_id"), "key").withColumnRenamed("doc_id", "__id")
    rows = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id"))).select("a", "block", "role", "key", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, group, head = WordHashes(), None, None
        for batch in batches:
            u, v = [], []
            for a, block, role, key, text in zip(*(batch.column(c) for c in ("a", "block", "role", "key", "text")), strict=True):
                a, key = a.as_py(), key.as_py()
                words = _words(text.as_py())
                if hashlib.blake2b(b" ".join(words), digest_size=16).digest() != key:
                    continue  # another text under the same id
                s = shingle_set(words, k, known)
                if role.as_py() == 0:
                    group, head = (a, block.as_py()), s
                    continue
                if group != (a, block.as_py()):
                    raise ValueError("a partner came before the text it is held against")
                both = len(np.intersect1d(head, s, assume_unique=True))
                if 100 * both >= percent * (len(head) + len(s) - both):
                    u.append(a)
                    v.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    spread = rows.repartition("a", "block").sortWithinPartitions("a", "block", "role")
    return cut(spread.mapInArrow(work, "u binary, v binary"), "links")


def find_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document.

    Linked are documents with 100 * intersection >= percent * union.
    """
    s = percent / 100
    least_equal = math.floor(COORDINATES * s - 5 * math.sqrt(COORDINATES * s * (1 - s)))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).cast("binary").alias("text"))
    rows = _signatures(docs, k)
    vertices = cut(
        rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("mins").alias("mins"), F.count("*").alias("copies")), "vertices"
    )
    leaf_rows, sketches = leaves(vertices), _with_sketches(vertices)
    links = confirm(cut(_first_turn(leaf_rows, sketches, least_equal), "pairs"), docs, vertices, k, percent)
    components = cut(connected_components(links), "components")
    candidates = _candidates(leaf_rows, components, sketches, least_equal)
    links = links.unionByName(_settle(candidates, components, docs, vertices, sketches, k, percent, least_equal))
    found = connected_components(links).withColumnRenamed("v", "key")
    named = vertices.select("key", "doc_id", "copies").join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members"))
    of_key = spread_join(named, least, "component", "members", "key").select("key", "component_id", "copies")
    out = spread_join(rows.select("doc_id", "key", "n"), cut(of_key, "of_key"), "key", "copies", "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with its columns; documents without words all stay."""
    found = find_components(docs, k, percent, id_col, text_col)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")  # whatever the columns are called
    own = docs.select(doc, F.col(id_col).alias("id"), F.sha2(whole(F.col(text_col)).cast("binary"), 256).alias("digest"))
    left = own.join(kept, F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    # Rows that share an id and a text are one document.
    tied = Window.partitionBy("id", "digest").orderBy("id")
    return left.withColumn("n", F.row_number().over(tied)).filter("n = 1").select("doc.*")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_components(docs, k=3, percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.v WHERE r.c < e.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) c ON c.v = d.doc_id
"""
