"""Fuzzy line deduplication over the corpus.

1. A line is trimmed and lower-cased; equal lines form a class, named by a
   63-bit hash. Lines without a word are never touched.
2. Shingles are the windows of ``FAMILIES`` characters, hashed to 64 bits; a
   shorter line is one shingle. Windows of 10 characters tell apart lines that
   share their words, but one letter changes ten of them; so lines of up to 160
   characters are compared by windows of 4, and lines of 120 or more by windows of
   10. A line of 120 to 160 characters is in both families, so that a line and its
   longer copy always meet in one.
3. MinHash over the distinct shingles, 32 bits a permutation. Bands of permutations
   are the keys under which classes meet; at a Jaccard similarity of 0.85 two lines
   share a band with a probability of 0.9995 in either family. Different lines of one
   language share many windows of 4 characters, so bands there are of 8 permutations:
   at a similarity of 0.2 lines meet once in 16,000 (once in 16 with bands of 3, which
   do for windows of 10).
4. In each key a representative is compared with all members, and those that do
   not join it with all others. Counts of shingles per hash block bound what two lines
   can share, so pairs that cannot be similar are not made and none that is similar is
   lost; the exact Jaccard similarity of full shingle sets decides, and distributed
   union-find joins the classes (see ``components.link_members``). In a key of many
   members no pairs are written down: pairs of chunks of members are compared as two
   matrices of shingles, and only the edges of a spanning forest leave a comparison.
5. Of all lines of a component the first one, by (doc_id, text hash, line number),
   stays.

Spark splits, shuffles, joins and groups; shingles are hashed and sets compared in
Arrow batches. DataFrame functions alone did not meet the time allowed; nor does this
form yet (see the README for both figures).

The texts of candidate lines are found through a filter of fixed size
(``common.FILTER_WORDS`` 64-bit words, whatever the corpus) that is broadcast; an exact
join follows.

Defined results: null and empty texts have no lines to drop; a row with a null
doc_id sorts first and is judged like others; rows that repeat a doc_id and its
text are one document, other texts under the same doc_id are documents of their
own; an empty table gives an empty result; extra columns stay as they are.
Two different lines with one 63-bit hash would count as equal (about one pair
among 4 billion different lines).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rugosa.llm.common import drop_worker_object, free_name, possibly_among, quoted, release, store
from rugosa.llm.components import FULL, components, link_members, shared_members
from rugosa.llm.near_duplicates import BLOCKS
from rugosa.session import ship_package

#: Characters of a shingle, with the least and the largest length of its lines.
FAMILIES = ((10, 120, None), (4, 1, 160))
#: By family, permutations of a band and number of bands.
BANDS = ((3, 8), (8, 24))
#: Least similarity in hundredths.
LEAST = 85
#: Characters that are hashed at once, about; a longer line is hashed alone.
SLICE_CHARS = 1 << 18
#: Shingles that a task remembers while it confirms pairs.
KEPT_SHINGLES = 1 << 21
#: Members of a chunk and their shingles, about, and columns of a matrix of them.
CHUNK_MEMBERS, CHUNK_SHINGLES, MATRIX_COLUMNS = 1024, 1 << 19, 2048

_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_MOST = max(rows * bands for rows, bands in BANDS)
_STREAM = _mix(np.arange(1, 2 * _MOST + 1, dtype=np.uint64) * np.uint64(_ODD)).astype(np.uint32)
_XOR, _MUL = _STREAM[:_MOST], _STREAM[_MOST:] | np.uint32(1)


def text_hash(text: Column) -> Column:
    """Tells texts apart that share a doc_id."""
    return F.xxhash64(text.cast("string"))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos, id (hash of the normalised line, an even number), line."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(text).alias("text_hash"), text.alias("text"))
    rows = rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    line = F.lower(F.trim("raw", F.lit(" \t\x0b\x0c\r")))
    rows = rows.select("doc_id", "text_hash", "pos", line.alias("line")).where("line <> ''")
    return rows.withColumn("id", F.expr("xxhash64(line) & -2L"))


def families(length: int) -> list[int]:
    """Numbers of the families that compare a line of this length."""
    return [f for f, (_, least, most) in enumerate(FAMILIES) if least <= length and (most is None or length <= most)]


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of the joined texts, and where those of each text
    start and end."""
    texts = [t.ljust(size, "\0") for t in texts]
    codes = np.frombuffer(("".join(texts) + "\0" * size).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    # windows of 1, 2, 4, ... characters, joined to windows of ``size``
    part, width, found, done = codes, 1, None, 0
    while width <= size:
        if size & width:
            if found is None:
                found = part
            else:
                m = len(codes) - done - width + 1
                found = found[:m] * np.uint64(pow(_ODD, width, 1 << 64)) + part[done : done + m]
            done += width
        part = part[: len(part) - width] * np.uint64(pow(_ODD, width, 1 << 64)) + part[width:]
        width *= 2
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.cumsum(lengths) - lengths
    return _mix(found + np.uint64(size)), starts, starts + lengths - size + 1


def keys_of(texts: list[str], family: int) -> np.ndarray:
    """The key of each band (columns) of each text (rows)."""
    hashes, starts, ends = shingles(texts, FAMILIES[family][0])
    edges = np.stack([starts, ends], axis=1).reshape(-1)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    rows, bands = BANDS[family]
    keys = np.empty((len(texts), bands), dtype=np.int64)
    mixed = np.empty_like(x)
    for b in range(bands):
        key = np.full(len(texts), b * len(FAMILIES) + family + 1, dtype=np.uint64)
        for i in range(b * rows, b * rows + rows):
            np.bitwise_xor(x, _XOR[i], out=mixed)
            np.multiply(mixed, _MUL[i], out=mixed)
            key = _mix(key * np.uint64(_ODD) + np.minimum.reduceat(mixed, edges)[::2])
        keys[:, b] = key.view(np.int64)
    return keys


def _slices(sizes: list[int]):
    """Ranges of about SLICE_CHARS characters."""
    at = used = 0
    for i, n in enumerate(sizes):
        if i > at and used + n > SLICE_CHARS:
            yield at, i
            at, used = i, 0
        used += n
    if at < len(sizes):
        yield at, len(sizes)


def signatures(found: DataFrame) -> DataFrame:
    """``doc_id, text_hash, pos, id`` of every line with its keys by family (none
    where the family does not compare it, or beside an equal line that has them)."""
    ship_package(found.sparkSession)
    names = [f"keys{f}" for f in range(len(FAMILIES))]

    def run(batches):
        drop_worker_object()
        for batch in batches:
            texts = batch.column(4).to_pylist()
            for at, end in _slices(list(map(len, texts))):
                own = texts[at:end]
                firsts = dict(zip(reversed(own), range(end - at - 1, -1, -1), strict=True))
                columns = []
                for f, (_, bands) in enumerate(BANDS):
                    members = [t for t in firsts if f in families(len(t))]
                    found_keys = np.zeros(end - at + 1, dtype=np.int32)
                    rows = sorted((firsts[t], t) for t in members)
                    found_keys[[i + 1 for i, _ in rows]] = bands
                    keys = keys_of([t for _, t in rows], f).reshape(-1) if rows else np.zeros(0, dtype=np.int64)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum(found_keys, dtype=np.int32)), pa.array(keys)))
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *columns], names=["doc_id", "text_hash", "pos", "id", *names])

    schema = "doc_id long, text_hash long, pos int, id long, " + ", ".join(f"{n} array<long>" for n in names)
    return found.select("doc_id", "text_hash", "pos", "id", "line").mapInArrow(run, schema)


def band_keys(signed: DataFrame) -> DataFrame:
    """``key, id`` of every class, perhaps more than once; the last bit of the id is
    the family."""
    every = [F.expr(f"transform(keys{f}, k -> struct(k as key, id | {f}L as id))") for f in range(len(FAMILIES))]
    return signed.select(F.explode(F.concat(*every)).alias("k")).select("k.*")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, line`` of the listed members."""
    ids = ids.select(F.col("id").alias("member"), F.expr("id & -2L").alias("own"))
    found = possibly_among(lines(docs), "id", ids.select("own"), "line-filter")
    found = found.groupBy("id").agg(F.first("line").alias("line"))
    return found.join(ids, found["id"] == ids["own"]).select(F.col("member").alias("id"), "line")


def shingle_set(member: int, text: str) -> np.ndarray:
    """Sorted different hashes of a member's shingles."""
    hashes, starts, ends = shingles([text], FAMILIES[member & 1][0])
    return np.unique(hashes[starts[0] : ends[0]])


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``id, set`` of every member."""

    def run(batches):
        for batch in batches:
            ids, own = (c.to_pylist() for c in batch.columns)
            for at, end in _slices(list(map(len, own))):
                sets = [shingle_set(i, t).tobytes() for i, t in zip(ids[at:end], own[at:end], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at:end], pa.int64()), pa.array(sets, pa.binary())], names=["id", "set"])

    return texts.select("id", "line").mapInArrow(run, "id long, set binary")


def confirmed(pairs: DataFrame, texts: DataFrame, least: int = LEAST) -> DataFrame:
    """Component edges of pairs whose full shingle sets are similar enough."""
    both = pairs.join(texts.toDF("a", "line_a"), "a").join(texts.toDF("b", "line_b"), "b")

    def run(batches):
        known: dict[int, np.ndarray] = {}
        used = 0

        def of(member: int, text: str) -> np.ndarray:
            nonlocal used
            if (got := known.get(member)) is None:
                got = shingle_set(member, text)
                if used + len(got) > KEPT_SHINGLES:
                    known.clear()
                    used = 0
                known[member] = got
                used += len(got)
            return got

        for batch in batches:
            u, v = [], []
            for ca, cb, a, b, line_a, line_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, q = of(a, line_a), of(b, line_b)
                common = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * common >= least * (len(p) + len(q) - common):
                    u.append(ca)
                    v.append(cb)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return both.select("ca", "cb", "a", "b", "line_a", "line_b").mapInArrow(run, "u long, v long")


def profile(texts: DataFrame) -> DataFrame:
    """``id, size, w0, ...`` of every member, see ``components.link_members``. Shingles
    that no other line holds count as well: to tell them apart takes a shuffle of all
    shingles, and among the lines of a large corpus few are left."""
    words = [f"w{i}" for i in range(BLOCKS // 4)]

    def run(batches):
        for batch in batches:
            ids, own = (c.to_pylist() for c in batch.columns)
            for at, end in _slices(list(map(len, own))):
                sets = [shingle_set(i, t) for i, t in zip(ids[at:end], own[at:end], strict=True)]
                sizes = np.array([len(s) for s in sets])
                cell = np.repeat(np.arange(end - at) * BLOCKS, sizes) + (np.concatenate(sets) % np.uint64(BLOCKS)).astype(np.int64)
                counts = np.minimum(np.bincount(cell, minlength=BLOCKS * (end - at)), FULL).astype("<u2").view("<i8").reshape(end - at, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at:end], pa.int64()), pa.array(sizes), *[pa.array(np.ascontiguousarray(w)) for w in counts.T]], names=["id", "size", *words]
                )

    return texts.select("id", "line").mapInArrow(run, "id long, size long, " + ", ".join(f"{w} long" for w in words))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of ``left`` (rows) shares with each of ``right``."""
    n, sets = len(left), [*left, *right]
    sizes = [len(s) for s in sets]
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    row, cut = np.repeat(np.arange(len(sets)), sizes), sum(sizes[:n])
    both = np.zeros((2, len(values)), dtype=bool)   # what one side alone holds is not shared
    both[0, code[:cut]] = both[1, code[cut:]] = True
    both = both.all(axis=0)
    row, code = row[both[code]], (np.cumsum(both) - 1)[code[both[code]]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros((n, len(right)))
    total = int(both.sum())
    ends = np.searchsorted(code, np.arange(0, total + MATRIX_COLUMNS, MATRIX_COLUMNS))
    for at, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        held = np.zeros((len(sets), MATRIX_COLUMNS), dtype=np.float32)
        held[row[a:b], code[a:b] - at * MATRIX_COLUMNS] = 1
        out += held[:n] @ held[n:].T
    return out


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Edges among ``u, v`` that link the same components without a cycle."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    out = []
    for x, y in dict.fromkeys(zip(u.tolist(), v.tolist(), strict=True)):
        a, b = root(x), root(y)
        if a != b:
            above[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def crowded_edges(placed: DataFrame, texts: DataFrame, least: int = LEAST) -> DataFrame:
    """Component edges that link all similar members of a key. Members are dealt to
    chunks and each chunk meets every other, in a group of its own, so that a hot key is
    spread; members of the key's main component are not compared with each other."""
    parts = F.ceil(F.greatest(F.col("n") / CHUNK_MEMBERS, F.col("total") / CHUNK_SHINGLES)).cast("int")
    rows = placed.select("key", "id", "component", (F.col("component") != F.col("main")).alias("apart"), parts.alias("parts"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).join(texts, "id")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    rows = rows.select("key", low, high, (F.col("own") > F.col("other")).alias("second"), "id", "component", "apart", "line")

    def run(table: pa.Table) -> pa.Table:
        ids, lines = table["id"].to_pylist(), table["line"].to_pylist()
        component, apart, second = (table[c].to_numpy() for c in ("component", "apart", "second"))
        if table["low"][0].as_py() == table["high"][0].as_py():
            meet = [(apart, np.ones(len(ids), dtype=bool))]
        else:
            meet = [(apart & ~second, second), (apart & second, ~apart & ~second)]
        u, v, sets = [], [], {}
        for left, right in meet:
            left, right = np.flatnonzero(left), np.flatnonzero(right)
            if not len(left) or not len(right):
                continue
            for i in (*left.tolist(), *right.tolist()):
                if i not in sets:
                    sets[i] = shingle_set(ids[i], lines[i])
            shared = shared_counts([sets[i] for i in left.tolist()], [sets[i] for i in right.tolist()]).astype(np.int64)
            size_l, size_r = (np.array([len(sets[i]) for i in side.tolist()]) for side in (left, right))
            near = (100 + least) * shared >= least * (size_l[:, None] + size_r[None, :])
            a, b = np.nonzero(near & (component[left][:, None] != component[right][None, :]))
            u.append(component[left[a]])
            v.append(component[right[b]])
        edges = _forest(np.concatenate(u), np.concatenate(v)) if u else []
        return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    # few bytes, much work: dealt to so many tasks whatever the size
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "key", "low", "high").groupBy("key", "low", "high").applyInArrow(run, "u long, v long")


def line_components(docs: DataFrame, signed: DataFrame, least: int = LEAST) -> DataFrame:
    """``id, component`` of the classes that share a key with another."""
    members = shared_members(band_keys(signed), "line")
    ids = store(members.select("id").distinct(), "line-ids")
    texts = store(_texts(docs, ids), "line-texts")
    sized = store(profile(texts), "line-profile")
    linked = link_members(
        members,
        sized,
        BLOCKS // 4,
        least,
        lambda pairs: confirmed(pairs, texts, least),
        "line",
        crowded=lambda placed: crowded_edges(placed, texts, least),
    )
    # a class that both families compare joins its two components
    own = F.expr("id & -2L")
    ends = linked.groupBy(own.alias("id")).agg(F.min("component").alias("v"), F.max("component").alias("u"))
    roots = components(ends.where("u <> v").select("u", "v"), "line-families")
    final = ends.select("id", F.col("v").alias("node")).join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("component"))
    for done in (members, ids, texts):
        release(done)
    return final


def dropped_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, text_hash, dropped``: sorted numbers (from 0) of the lines that go,
    for documents that lose any."""
    signed = store(signatures(lines(docs)), "line-signed")
    linked = line_components(docs, signed, least)
    line = F.struct("doc_id", "text_hash", "pos")
    placed = signed.select("doc_id", "text_hash", "pos", "id").join(linked, "id", "left")
    placed = placed.select(line.alias("line"), F.coalesce("component", "id").alias("component"))
    firsts = (
        placed.groupBy("component")
        .agg(F.min("line").alias("first"), F.max("line").alias("last"))
        .where("first <> last")
        .select("component", "first")
    )
    gone = placed.join(firsts, "component").where(~F.equal_null(F.col("line"), F.col("first"))).select("line.*")
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_kept and dropped (line numbers) of every document."""
    gone = dropped_lines(docs, least).toDF("_doc", "_hash", "dropped")
    text = F.col("text").cast("string")
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_hash(text).alias("text_hash"),
        F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).alias("n_lines"),
    )
    out = sizes.join(gone, F.equal_null(F.col("doc_id"), F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    dropped = F.coalesce("dropped", F.expr("cast(array() as array<int>)"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size(dropped)).alias("n_kept"), dropped.alias("dropped"))


def without_repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents with their kept lines as ``text``, all other columns as they
    were; a document that loses every line with a word is left out."""
    gone = dropped_lines(docs, least)
    # other columns may have any name
    own = {c: F.col(f"d.{quoted(c)}") for c in docs.columns}
    new_text, dropped = free_name(docs, "text"), F.col("g.dropped")
    joined = docs.alias("d").join(gone.alias("g"), F.equal_null(own["doc_id"].cast("long"), F.col("g.doc_id")) & (text_hash(own["text"]) == F.col("g.text_hash")), "left")
    raw = F.split(own["text"], "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), dropped)
    text = F.when(dropped.isNull(), own["text"]).otherwise(F.array_join(F.transform(kept, lambda i: F.get(raw, i)), "\n"))
    out = joined.select(*own.values(), text.alias(new_text), dropped.isNotNull().alias(new_text + "_cut"))
    out = out.where(~F.col(new_text + "_cut") | F.col(new_text).rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col(new_text).alias(c) if c == "text" else F.col(quoted(c)) for c in docs.columns])
