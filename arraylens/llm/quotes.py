"""Chat formatting (operator 2): quotation linking.

Messages are cut into their own text and quoted passages by quote level. The
hashes of a passage's normalised text, as a whole and by paragraph and line, are
joined to the first message that wrote the same text, in the conversation or
else anywhere before. Replies follow the links, or the turn before where nothing
is quoted; each tree of replies becomes one conversation, in which every message
comes after the one that it answers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arraylens.llm.staging import Stage, bound_batches

MARK = re.compile(r"[ \t]*(?:>[ \t]?)+")
#: Last line before a quote that names its author.
ATTRIBUTION = re.compile(r"(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", re.IGNORECASE)


def digest(words: list[str]) -> tuple[int, int] | None:
    """Hash and length of a passage, whatever its white space, line breaks and case; None if blank."""
    if not words:
        return None
    s = " ".join(words).casefold()
    h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    return (h - (1 << 64) if h >= 1 << 63 else h), len(s)


def keys(lines: list[str]) -> list[tuple[int, int]]:
    """Digests of a passage, its paragraphs and its lines, the longest first."""
    cut = [x.split() for x in lines]
    paragraphs, held = [], []
    for w in [*cut, []]:
        if w:
            held = held + w
        elif held:
            paragraphs.append(held)
            held = []
    found = {digest([x for w in cut for x in w]), *map(digest, paragraphs), *map(digest, cut)} - {None}
    return sorted(found, key=lambda x: (-x[1], x[0]))


def parse(text: str | None) -> tuple[str | None, list[tuple[int, list[str]]]]:
    """A message's own text, and its quoted passages with their levels from 1 on, top to bottom."""
    if text is None:
        return None, []
    rows = []
    for line in text.split("\n"):
        m = MARK.match(line)
        rows.append((m.group().count(">") if m else 0, line[m.end() :] if m else line))
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for i, (level, line) in enumerate(rows):
        after = next((x for x, t in rows[i + 1 : i + 4] if x > level or t.strip()), level)
        if after > level and ATTRIBUTION.search(line):
            before = -1 if level else 0
            continue
        if not level:
            own.append(line)
        elif level == before and passages:
            passages[-1][1].append(line)
        else:
            passages.append((level, [line]))
        before = level
    if not passages:
        return text, []
    return "\n".join(own).strip("\n"), [p for p in passages if any(x.split() for x in p[1])]


_KEY = pa.struct([("hash", pa.int64()), ("size", pa.int32())])
_QUOTE = pa.struct([("level", pa.int32()), ("keys", pa.list_(_KEY))])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [parse(t) for t in batch.column("text").to_pylist()]
        bodies = pa.array([b for b, _ in done], pa.string())
        own = pa.array([[{"hash": h, "size": n} for h, n in keys((b or "").split("\n"))] for b, _ in done], pa.list_(_KEY))
        quotes = pa.array([[{"level": lv, "keys": [{"hash": h, "size": n} for h, n in keys(x)]} for lv, x in q] for _, q in done], pa.list_(_QUOTE))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv", "turn", "role")), bodies, own, quotes], names=["conv", "turn", "role", "body", "own", "quotes"]
        )


def numbered(df: DataFrame, stage: Stage, key: str, order: list[str], out: str) -> DataFrame:
    """df with numbers from 0 within each key, by `order`, from one range-partitioned sort.

    A key may lie in several partitions; its rows there are shifted by those before.
    """
    parts = int(stage.spark.conf.get("spark.sql.shuffle.partitions"))
    put = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    put = put.withColumn("_seq", F.monotonically_increasing_id())
    put = stage.keep(put.withColumn("_part", F.shiftright("_seq", 33)), "sorted")
    sizes = put.groupBy(key, "_part").agg(F.min("_seq").alias("_lo"), F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo")).alias("_shift"))
    return put.join(sizes, [key, "_part"]).withColumn(out, F.col("_seq") + F.col("_shift")).drop("_part", "_shift")


def roots(links: DataFrame, stage: Stage) -> DataFrame:
    """(node, root) of each node of a forest of links (node, up), nodes of which are distinct; roots have no link.

    The links double their length each round: log2 of the depth in rounds. Nodes that point at a root are set aside.
    """
    inner = links.select(F.col("node").alias("up"), F.lit(True).alias("inner"))
    hop = links.join(inner, "up", "left").select("node", "up", F.col("inner").isNull().alias("done"))
    hop = stage.keep(hop, "hops")
    fixed, todo = hop.where("done"), hop.where("not done")
    while not todo.isEmpty():
        known = fixed.unionByName(todo).select(F.col("node").alias("up"), F.col("up").alias("next"), "done")
        hop = todo.select("node", "up").join(known, "up").select("node", F.col("next").alias("up"), "done")
        hop = stage.keep(hop, "hops")
        fixed, todo = fixed.unionByName(hop.where("done")), hop.where("not done")
    return fixed.select("node", F.col("up").alias("root"))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """(conv_id, turn, role, body, n_quotes, n_linked, via, reply_conv, reply_turn, thread_conv, thread_turn, position).

    body is the text without quotes and their attribution lines. Of a passage's
    digests that some earlier message wrote (itself or as a paragraph or line),
    the longest one counts, in the same conversation before any other; its
    source is the first writer. A message answers the source of its longest
    level-1 passage, the topmost on ties (via `quote`), or else the turn
    before it (via `turn`); the rest are roots (via `root`). position counts a
    thread's messages from 0, sources before replies.

    Null and empty texts quote nothing; texts of any length are read whole, in
    linear time; an empty table gives an empty one. Rows that share conv_id and turn are
    messages of their own, in the order of role and text. Rows with a null
    conv_id or turn are roots of their own threads at position 0, with null
    thread columns, and are nobody's source. Other columns are ignored.
    """
    spark = messages.sparkSession
    stage = Stage(spark)
    bound_batches(spark)
    given = messages.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    ddl = "conv long, turn long, role string, body string, own array<struct<hash:long,size:int>>, quotes array<struct<level:int,keys:array<struct<hash:long,size:int>>>>"
    parsed = stage.keep(given.mapInArrow(_parsed, ddl), "parsed")
    whole = parsed.where("conv is not null and turn is not null")
    rows = stage.keep(numbered(whole, stage, "conv", ["turn", "role", "body"], "at").withColumnRenamed("_seq", "node"), "rows")

    own = rows.select("conv", "node", F.explode("own").alias("k")).select("conv", "node", "k.hash")
    near = own.groupBy("conv", "hash").agg(F.min("node").alias("near"))
    far = own.groupBy("hash").agg(F.min("node").alias("far"))
    quotes = rows.select("node", "conv", F.posexplode("quotes").alias("passage", "q"))
    quotes = quotes.select("node", "conv", "passage", "q.level", F.explode("q.keys").alias("k"))
    quotes = quotes.select("node", "conv", "passage", "level", "k.hash", "k.size")
    # kept, so that the rows of an often quoted passage can be split over tasks where they meet its writer
    far = stage.keep(far.join(quotes.select("hash").distinct(), "hash", "left_semi"), "writers")
    quotes = stage.keep(quotes.join(near, ["conv", "hash"], "left"), "quotes")
    hits = quotes.join(far, "hash", "left")
    near_ok, far_ok = F.col("near") < F.col("node"), F.col("far") < F.col("node")
    hits = hits.withColumn("source", F.when(near_ok, F.col("near")).when(far_ok, F.col("far"))).where("source is not null")
    best = F.max_by(F.struct("source", "size", "level"), F.struct(near_ok.cast("int"), "size", -F.col("source"))).alias("b")
    passages = stage.keep(hits.groupBy("node", "passage").agg(best).select("node", "passage", "b.*"), "links")
    replies = passages.groupBy("node").agg(
        F.count("*").alias("n_linked"), F.max_by(F.when(F.col("level") == 1, F.col("source")), F.struct(F.col("level") == 1, "size", -F.col("passage"))).alias("source")
    )
    prior = rows.select("conv", (F.col("at") + 1).alias("at"), F.col("node").alias("prior"))
    rows = rows.join(prior, ["conv", "at"], "left").join(replies, "node", "left")
    rows = rows.withColumn("parent", F.coalesce("source", "prior")).withColumn(
        "via", F.when(F.col("source").isNotNull(), "quote").when(F.col("prior").isNotNull(), "turn").otherwise("root")
    )
    rows = stage.keep(rows.select("node", "conv", "turn", "role", "body", F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent", "via"), "replies")
    trees = roots(rows.where("parent is not null").select("node", F.col("parent").alias("up")), stage)
    rows = rows.join(trees, "node", "left").withColumn("thread", F.coalesce("root", "node")).drop("root")
    rows = numbered(rows, stage, "thread", ["node"], "position").drop("_seq")
    names = stage.keep(rows.select("node", "conv", "turn"), "names")
    reply = names.select(F.col("node").alias("parent"), F.col("conv").alias("reply_conv"), F.col("turn").alias("reply_turn"))
    root = names.select(F.col("node").alias("thread"), F.col("conv").alias("thread_conv"), F.col("turn").alias("thread_turn"))
    out = rows.join(reply, "parent", "left").join(root, "thread")
    columns = [
        F.col("conv").alias("conv_id"), "turn", "role", "body", F.col("n_quotes").cast("long").alias("n_quotes"), F.col("n_linked").cast("long").alias("n_linked"),
        "via", "reply_conv", "reply_turn", "thread_conv", "thread_turn", F.col("position").cast("long").alias("position"),
    ]
    none = F.lit(None).cast("long")
    loose = parsed.where("conv is null or turn is null").withColumns(
        {"n_quotes": F.size("quotes"), "n_linked": F.lit(0), "via": F.lit("root"), "reply_conv": none, "reply_turn": none}
        | {"thread_conv": none, "thread_turn": none, "position": F.lit(0)}
    )
    return out.select(*columns).unionByName(loose.select(*columns))
