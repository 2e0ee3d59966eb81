"""N-gram Jaccard join (operator 4): rare-first prefix filtering.

1. One pass over the texts writes, for each document, the size of its shingle
   set, a 128-bit fingerprint of the set and a parity signature, and counts
   shingles in a table of fixed size. Equal sets become one class.
2. Shingles are ordered by their counted frequency, then by hash: any fixed
   order is exact, a rare-first one keeps posting lists short. Each set sends
   its prefix of |x| - ceil(t|x|) + 1 first shingles, once a task and set. The
   lists of shingles that are counted often are dealt over SALTS tasks each,
   in all joins that follow.
3. Posting lists of two documents and more are kept. Rounds of stars link the
   members of each list to a few drawn pivots; members that a link already
   connects are never paired again. What stars leave apart is then joined in
   full, on its first common prefix shingle, so no link between components is
   lost while a group of n near copies costs about n pairs and not n squared.
4. Pairs must pass the length, positional and suffix filters; those that pass
   are verified once, exactly, on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arraylens.llm.components import connected_components
from arraylens.llm.shingles import mix, overlap, shingle_sets
from arraylens.llm.staging import Stage, bound_batches, with_text

#: Counters of the frequency table, a fixed size at any scale, by the highest bits of a shingle.
COUNTER_BITS = 18
COUNTERS = 1 << COUNTER_BITS
#: Tasks over which the list of an often counted shingle is dealt.
SALTS = 32
#: Longs of the parity signature.
PARITY = 8
#: Count from which a list may be dealt over several tasks.
HOT = 256
#: Rounds in which lists are linked by stars before the rest is joined in full.
STAR_ROUNDS = 2
#: Pivots drawn from a list in a round.
PIVOTS = 8

_SIDES = [f"s{i}" for i in range(PARITY)]


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    if not len(s):
        return 0, 0
    a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int((b + np.uint64(len(s))).view(np.int64))


def parity(s: np.ndarray) -> np.ndarray:
    """Parities of the set's sizes in 64 * PARITY parts of the shingle space."""
    odd = np.bincount((mix(s) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _profile(k: int):
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("fq", pa.int64())]
    fields += [(c, pa.int64()) for c in _SIDES] + [("bucket", pa.int32()), ("cnt", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            rows, parts = [], []
            for s in shingle_sets(batch.column(1), k):
                parts.append(s >> np.uint64(64 - COUNTER_BITS))
                rows.append((len(s), *fingerprint(s), *parity(s)))
            if parts:
                held, n = np.unique(np.concatenate(parts).astype(np.int64), return_counts=True)
                counts[held] += n.astype(np.uint32)
            made = np.array(rows, np.int64).reshape(len(rows), 3 + PARITY)
            nulls = pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made.T), *nulls], schema=schema)
        at = np.flatnonzero(counts)
        nulls = [pa.nulls(len(at), pa.int64())] * (4 + PARITY)
        yield pa.RecordBatch.from_arrays([*nulls, pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], schema=schema)

    ddl = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'long'}" for f in schema)
    return run, ddl


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _prefixes(k: int, num: int, den: int, counts: np.ndarray, hot: float):
    """Prefix postings; salt is 0, or 1 to SALTS where the shingle's count is above `hot`."""
    schema = pa.schema([("token", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("salt", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set = set()
        for batch in batches:
            tokens, docs, sizes, places, salts = [], [], [], [], []
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k), strict=True):
                if doc is None or not len(s) or (key := fingerprint(s)) in sent:
                    continue
                sent.add(key)
                p = prefix_length(len(s), num, den)
                often = counts[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                order = np.lexsort((s, often))[:p]
                tokens.append(s[order].view(np.int64))
                docs.append(np.full(p, doc, np.int64))
                sizes.append(np.full(p, len(s), np.int32))
                places.append(np.arange(p, dtype=np.int32))
                salts.append(np.where(often[order] > hot, 1 + (doc ^ doc >> 16) % SALTS, 0).astype(np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, docs, sizes, places, salts)], schema=schema)

    return run, "token long, doc long, n int, pos int, salt int"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, those whose token comes twice at least or is salted, as its other rows may be elsewhere."""
    held, again = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        t = batch.column(0).to_numpy()
        same = t[1:] == t[:-1]
        before = np.append(held is not None and held.column(0)[0].as_py() == t[0], same)
        if held is not None and (again or before[0] or held.column(4)[0].as_py()):
            yield held
        keep = before | (batch.column(4).to_numpy() > 0)
        keep[:-1] |= same
        again = bool(before[-1])
        held = batch.slice(len(t) - 1, 1)
        out = batch.slice(0, len(t) - 1).filter(pa.array(keep[:-1]))
        if out.num_rows:
            yield out
    if held is not None and (again or held.column(4)[0].as_py()):
        yield held


def _verify(k: int, num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("same", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            same = []
            for x, y in zip(shingle_sets(batch.column("ta"), k), shingle_sets(batch.column("tb"), k), strict=True):
                both = overlap(x, y)
                same.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(same, pa.bool_())], schema=schema)

    return run, "a long, b long, same boolean"


def _dealt(lists: DataFrame) -> DataFrame:
    """One row for each salt that the rows of a token have."""
    salts = F.when(F.col("salted"), F.sequence(F.lit(1), F.lit(SALTS))).otherwise(F.array(F.lit(0)))
    return lists.withColumn("salt", F.explode(salts)).drop("salted")


def _need(num: int, den: int) -> Column:
    """Shingles that a linked pair x, y shares at least."""
    return F.ceil(F.lit(num) * (F.col("x.n") + F.col("y.n")) / F.lit(num + den))


def _close(num: int, den: int) -> Column:
    """Length and positional filter on two postings x, y of a shingle, their pair's first in common."""
    nx, ny = F.col("x.n"), F.col("y.n")
    rest = 1 + F.least(nx - 1 - F.col("x.pos"), ny - 1 - F.col("y.pos"))
    return (F.least(nx, ny) * den >= F.greatest(nx, ny) * num) & (rest >= _need(num, den))


def _suffix(num: int, den: int) -> Column:
    """Suffix filter: odd differences of the parts of two sets count into their Hamming distance."""
    apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _SIDES), F.lit(0))
    return apart <= F.col("x.n") + F.col("y.n") - 2 * _need(num, den)


def near_duplicates(
    documents: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id) for each row of documents.

    Two texts link when their Jaccard similarity on distinct k-word shingles is
    num/den or more; component_id is the smallest doc_id reachable by links and
    set_id the smallest doc_id with an equal set.

    Null, empty and blank texts have n_shingles 0 and stand alone. Texts of
    fewer than k words have their whole sequence as one shingle. Rows that
    share a doc_id are one node with the links of all its texts. A row with a
    null doc_id links with nothing and has a null component_id. An empty table
    gives an empty table. Other columns of the input are ignored.
    """
    spark = documents.sparkSession
    stage = Stage(spark)
    docs = with_text(documents, id_col, text_col)
    bound_batches(spark)
    run, ddl = _profile(k)
    profile = stage.keep(docs.mapInArrow(run, ddl), "profile")
    # COUNTERS rows at most, whatever the input
    rows = profile.where("bucket is not null").groupBy("bucket").agg(F.sum("cnt").alias("c")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("c").to_numpy()
    # well above what a counter holds by chance, and a good part of a shuffled partition
    hot = max(HOT, 4 * counts.mean(), counts.sum() * (den - num) / den / (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))) / 8)

    meta = profile.where("bucket is null")
    classes = meta.where("n > 0 and doc_id is not null").groupBy("fp", "fq", "n").agg(F.min("doc_id").alias("rep"))
    known = stage.keep(
        meta.join(classes, ["fp", "fq", "n"], "left").select("doc_id", "n", "rep", *_SIDES), "classes"
    )

    run, ddl = _prefixes(k, num, den, counts, hot)
    postings = docs.mapInArrow(run, ddl).repartition(F.col("token"), F.col("salt")).sortWithinPartitions("token")
    shared = stage.keep(postings.mapInArrow(_shared, ddl), "postings")
    stage.drop(profile)
    nodes = known.where("rep is not null")
    same = nodes.select(F.col("doc_id").alias("doc"), "n", "rep").distinct()
    salt = F.when(F.col("salt") > 0, 1 + F.pmod(F.xxhash64("rep"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt")
    named = shared.join(same, ["doc", "n"]).select("token", F.col("rep").alias("doc"), "n", "pos", salt)
    lists = stage.keep(named.distinct(), "lists")
    stage.drop(shared)
    sides = nodes.where("doc_id = rep").select(F.col("rep").alias("doc"), "n", *_SIDES).distinct()

    # texts of the documents in lists, once; the others are not needed again
    ids = lists.select(F.col("doc").alias("doc_id")).distinct().hint("shuffle_hash")
    texts = stage.keep(docs.join(ids, "doc_id", "left_semi"), "texts", compression="zstd")

    # a doc_id with several texts joins their classes
    ids = known.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("dst"), F.max("rep").alias("hi"))
    links = known.join(ids.where("dst < hi"), "doc_id").where("rep > dst").select(F.col("rep").alias("src"), "dst")
    found: list[DataFrame] = []  # verified pairs, one table a round
    parts = None
    for r in range(STAR_ROUNDS + 1):
        here = lists.select("token", "doc", "n", "pos", "salt", F.col("doc").alias("component"))
        if parts is not None:
            here = here.drop("component").join(parts, F.col("doc") == F.col("node"), "left").drop("node")
            here = here.withColumn("component", F.coalesce("component", "doc"))
        # a pair's first common shingle lies among the first n - ceil(2t/(1+t) n) + 1 of the smaller set
        index = F.max(F.col("pos") <= F.col("n") - F.ceil(F.lit(2 * num) * F.col("n") / F.lit(num + den)))
        salted = F.max(F.col("salt") > 0).alias("salted")
        open_ = here.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), index.alias("i"), salted)
        open_ = _dealt(open_.where("lo < hi and i").select("token", "salted"))
        here = stage.keep(here.join(open_, ["token", "salt"], "left_semi"), "open")
        stage.drop(lists)
        lists = here
        if here.isEmpty():
            break
        if r < STAR_ROUNDS:
            row = F.struct("doc", "n", "pos", "component")
            drawn = [F.min_by(row, F.xxhash64("doc", F.lit(PIVOTS * r + i))) for i in range(PIVOTS)]
            pivots = here.groupBy("token").agg(F.array_distinct(F.array(*drawn)).alias("p"), salted)
            pivots = _dealt(pivots.select("token", "salted", F.explode("p").alias("p")).select("token", "salted", "p.*"))
            pairs = here.alias("x").join(pivots.alias("y"), ["token", "salt"])
            pairs = pairs.where((F.col("x.component") != F.col("y.component")) & _close(num, den))
        else:
            # signatures travel with what is left, so the join itself gives out only pairs that pass all filters
            signed = stage.keep(here.join(sides, ["doc", "n"]), "signed")
            others = _dealt(signed.withColumn("salted", F.col("salt") > 0).drop("salt"))
            pairs = signed.alias("x").join(others.alias("y"), ["token", "salt"])
            pairs = pairs.where((F.col("x.component") < F.col("y.component")) & _close(num, den) & _suffix(num, den))
        pairs = pairs.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()
        if r < STAR_ROUNDS:
            pairs = pairs.join(sides.alias("x"), F.col("x.doc") == F.col("a")).join(sides.alias("y"), F.col("y.doc") == F.col("b"))
            pairs = pairs.where(_suffix(num, den)).select("a", "b").distinct()
        for done in found:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = stage.keep(pairs, "pairs")
        if r == STAR_ROUNDS:
            stage.drop(signed)
        run, ddl = _verify(k, num, den)
        first_text = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
        second_text = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        checked = stage.keep(pairs.join(first_text, "a").join(second_text, "b").mapInArrow(run, ddl), "checked")
        stage.drop(pairs)
        found.append(checked)
        good = checked.where("same").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        parts = connected_components(links.unionByName(good), stage)
        links = parts.where("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst"))
    if parts is None:
        parts = connected_components(links, stage)
    stage.drop(texts, lists, *found)
    out = known.join(parts, known.rep == parts.node, "left")
    has_id = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(has_id, F.coalesce("component", "rep", "doc_id")).alias("component_id"),
        F.when(has_id, F.coalesce("rep", "doc_id")).alias("set_id"),
    )


#: DuckDB SQL of near_duplicates with its defaults on `documents`.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS f FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT p.b AS a, r.c FROM r JOIN p ON p.a = r.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a),
e AS (SELECT f, min(doc_id) AS e FROM n GROUP BY f)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, documents.doc_id) AS component_id, coalesce(e.e, documents.doc_id) AS set_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = documents.doc_id LEFT JOIN e ON e.f = n.f
"""
