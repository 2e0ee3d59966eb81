"""Personal data by bootstrapped contextual extraction (operator 7), DataFrame functions only.

Base patterns find e-mails, IP addresses, cards and phone numbers. Each whole
base span is a seed instance, and so is each token shaped like a secret key. The
other tokens outside of base spans, with digits or not, are candidates. The
words beside an instance are the lexical patterns. Patterns and instances form a
graph whose scores are iterated until they settle: a pattern scores the mean
confidence of its instances, an instance the noisy-or of its accepted patterns.
Tokens that accepted patterns reach with high confidence are added as spans of
kind `id`; a token without digits must also stand in accepted patterns in half
of its places, so that a common word in one of them is not taken.

The graph has an edge for each token and pattern, so only what can matter is
listed: a pattern with few confident instances, or with too many others, can't
be accepted. Others that are seen in one part of the texts are others in all of
them, so one part in PARTS rules out the patterns of common words for certain;
what is left is listed and counted exactly over all texts. Tokens are never
stored: each pass that needs them cuts the texts anew.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arraylens.llm.staging import Stage, with_text

# The base patterns, in linear-time form. Possessive loops give
# the same matches where the next character can't be one of the loop; the
# assertions in front skip starts inside a run that its first start has tried.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this character has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: What is cut off a token, in front and behind.
LEAD, TRAIL = r"^[^\p{L}\p{N}+(]++", r"(?<![^\p{L}\p{N})])[^\p{L}\p{N})]++$"

#: A token of this shape is a seed: letters and digits mixed, as keys and hashes are.
SECRET = r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/=_-]{24,}$"
#: A text without such a run has no token of that shape.
SECRET_PART = r"[A-Za-z0-9+/=_-]{24}"
#: Instances that a pattern needs, and the scores to be accepted.
SUPPORT, PATTERN_SCORE, INSTANCE_SCORE = 5, 0.8, 0.8
#: Parts of the texts, of which one is looked at before patterns are listed.
PARTS = 16
#: Left word, two left words, right word, left and right word.
PS = ("L", "LL", "R", "LR")
#: Share of the places of a token without digits that accepted patterns must reach.
PLACES = 0.5
#: Longs of the bitmap that sifts hashes before they are joined to a set of them.
SIEVE = 4096
#: Rows of a set of hashes that are still broadcast.
FEW = 2_000_000
#: How tables of texts and of all tokens are written.
PACKED = {"compression": "zstd", "parquet.dictionary.page.size": str(2**24)}


def matches(text: Column, pattern: str) -> Column:
    """Array of (gap before the match, match); the last element has the gap at the end and a null match."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.arrays_zip(gaps.alias("gap"), found.alias("val"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    each = F.split(F.reverse(digits), "")

    def term(d: Column, i: Column) -> Column:
        x = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(each, term), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, val: Column) -> Column:
    digits = F.regexp_replace(val, "[^0-9]", "")
    parts = F.transform(F.split(val, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), luhn(digits)))
        .otherwise(F.length(digits).between(9, 15))
    )


def coded(value: Column) -> Column:
    """Hash of an instance; the lowest bit says whether it has digits, the next whether it is shaped like a secret."""
    bits = value.rlike("[0-9]").cast("long") + F.when((F.length(value) >= 24) & value.rlike(SECRET), 2).otherwise(0)
    return F.when(value != "", F.xxhash64(value).bitwiseAND(F.lit(-4)).bitwiseOR(bits))


def each_pattern(near: Column, far: Column, after: Column) -> list[Column]:
    """Hashes of the lexical patterns PS, from those of the words beside an instance; null where a word is lacking."""
    return [
        F.when(near.isNotNull(), F.xxhash64(F.lit("L"), near)),
        F.when(near.isNotNull() & far.isNotNull(), F.xxhash64(F.lit("LL"), far, near)),
        F.when(after.isNotNull(), F.xxhash64(F.lit("R"), after)),
        F.when(near.isNotNull() & after.isNotNull(), F.xxhash64(F.lit("LR"), near, after)),
    ]


def few(df: DataFrame) -> DataFrame:
    """A kept set of hashes, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= FEW else df


def sieve(df: DataFrame, name: str) -> Callable[[Column], Column]:
    """A test that is true for all hashes of the set df and for few others: SIEVE longs, whatever the size of df."""
    x = F.col(name)
    place, bit = F.shiftright(x, 6).bitwiseAND(F.lit(SIEVE - 1)), F.expr(f"shiftleft(1L, int(`{name}` & 63))")
    held = {r[0]: r[1] for r in df.groupBy(place.alias("i")).agg(F.bit_or(bit).alias("b")).collect()}
    bits = F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(SIEVE))), ",").cast("array<bigint>")

    def test(h: Column) -> Column:
        word = F.get(bits, F.shiftright(h, 6).bitwiseAND(F.lit(SIEVE - 1)).cast("int"))
        return F.coalesce(F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))

    return test


def total(df: DataFrame, *names: str) -> tuple:
    """Rows and a sum of hashes, equal for equal tables; numbers count to nine digits."""
    kinds = dict(df.dtypes)
    parts = [F.round(c, 9) if kinds[c] == "double" else F.col(c) for c in names]
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*parts).cast("decimal(38,0)"))).first())


def learn(stage: Stage, units: DataFrame, base: DataFrame, shaped: DataFrame) -> DataFrame:
    """(v) of the values that accepted patterns reach, seeds too.

    units has v and w by token, base the edges (v, p) of base spans, shaped the
    units of texts that may hold tokens shaped like secrets. units is read anew
    in each pass. Scores only rise, and every value that an accepted pattern
    reaches is accepted. So rounds end once none brings a new value, and no
    pattern is open: below its threshold by its score, but not by the share of
    its values that are accepted, to which its score may rise. Open patterns are
    followed until their scores stand still to nine digits.
    """
    # neighbours by shifted arrays: each array is made once a row, however long
    none = F.array(F.lit(None).cast("long"))
    sides = [F.concat(none, "w").alias("near"), F.concat(none, none, "w").alias("far"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("after")]
    near, far, after_ = (F.col(f"t.{c}") for c in ("near", "far", "after"))

    def tokens(u: DataFrame) -> DataFrame:
        t = u.select("row", F.posexplode(F.arrays_zip(F.col("v"), *sides)).alias("at", "t")).where("t.v is not null")
        return t.select("row", "at", "t.v", *[h.alias(c) for h, c in zip(each_pattern(near, far, after_), PS, strict=True)])

    toks, part = tokens(units), tokens(units.where(F.pmod(F.xxhash64("row"), F.lit(PARTS)) == 0))

    def edges(t: DataFrame, kept: DataFrame | None = None) -> DataFrame:
        if kept is not None:
            test = sieve(kept, "p")
            t = t.where(reduce(or_, [test(F.col(c)) for c in PS]))
        e = t.select("row", "at", "v", F.explode(F.array(*PS)).alias("p")).where("p is not null")
        return e if kept is None else e.join(few(kept.select("p")), "p", "left_semi")

    def of(values: DataFrame) -> DataFrame:
        """The tokens of a set of values."""
        return toks.where(sieve(values, "v")(F.col("v"))).join(few(values), "v", "left_semi")

    shaped = tokens(shaped).where("v & 2 <> 0").select("v", F.explode(F.array(*PS)).alias("p"))
    base = stage.keep(base.unionByName(shaped).distinct(), "seeds")
    scores = stage.keep(base.select("v").distinct().withColumn("confidence", F.lit(1.0)), "scores")
    base = known = base.where("p is not null")
    listed = fresh = before = placed = rare = None
    while True:
        if fresh is None or not fresh.isEmpty():
            if fresh is not None:
                found = edges(of(fresh)).select("p", "v")
                known = stage.keep(known.unionByName(found).distinct(), "edges")
            may = known.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
            may = stage.keep(may if listed is None else may.join(listed.select("p").distinct(), "p", "left_anti"), "may")
            if not may.isEmpty():
                others = edges(part, may).join(few(scores.select("v")), "v", "left_anti")
                others = others.groupBy("p").agg(F.count_distinct("v").alias("others"))
                most = F.col("n") * (1 - PATTERN_SCORE) / PATTERN_SCORE + 1e-9
                may = stage.keep(may.join(others, "p", "left").where(F.coalesce("others", F.lit(0)) <= most).select("p"), "may")
            if not may.isEmpty():
                full = edges(toks, may).select("p", "v").unionByName(base.join(may, "p", "left_semi").select("p", "v")).distinct()
                listed = stage.keep(full if listed is None else listed.unionByName(full), "listed")
        if listed is None:
            break
        patterns = listed.join(scores, "v", "left").groupBy("p")
        sure = F.coalesce("confidence", F.lit(0.0))
        accepted = F.when(sure >= INSTANCE_SCORE, 1).otherwise(0)
        patterns = patterns.agg(F.avg(sure).alias("score"), F.sum(accepted).alias("n"), F.avg(accepted).alias("share"))
        patterns = patterns.where((F.col("share") >= PATTERN_SCORE) & (F.col("n") >= SUPPORT)).select("p", "score")
        judged = stage.keep(patterns, "patterns")
        patterns = judged.where(F.col("score") >= PATTERN_SCORE)
        reached = listed.join(patterns, "p").groupBy("v")
        either = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))))
        reached = stage.keep(reached.agg(F.greatest(F.max("score"), either).alias("reached")), "reached")
        plain = stage.keep(reached.where("v & 1 = 0").join(scores, "v", "left_anti").select("v"), "plain")
        if not plain.isEmpty():
            here = total(patterns, "p"), total(plain, "v")
            if here != placed:  # else their places are known
                placed = here
                there = of(plain)
                all_ = there.groupBy("v").agg(F.count("*").alias("total"))
                inside = edges(there, patterns).select("v", "row", "at").distinct().groupBy("v").agg(F.count("*").alias("inside"))
                rare = stage.keep(all_.join(inside, "v", "left").where(F.col("total") * PLACES > F.coalesce("inside", F.lit(0))).select("v"), "rare")
            reached = reached.join(rare, "v", "left_anti")
        after = scores.join(reached, "v", "full")
        after = stage.keep(after.select("v", F.greatest("confidence", "reached").alias("confidence")), "scores")
        fresh = stage.keep(after.join(scores, "v", "left_anti").select("v"), "fresh")
        scores = after
        now = total(judged.where(F.col("score") < PATTERN_SCORE), "p", "score")
        if fresh.isEmpty() and (not now[0] or now == before):
            break
        before = now
    return scores.where(F.col("confidence") >= INSTANCE_SCORE).select("v")


def extract(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (row, doc_id) has each input row, spans (row, kind, start, end, value, base) what was found.

    start and end count code points, end exclusive. Base spans are leftmost and
    non-overlapping within a kind and checked after matching; learned spans have
    kind `id` and overlap no base span. Null and empty texts have no spans;
    repeated rows have each their own; texts of any length are read whole; ties
    don't arise, as all matches and tokens are judged alike; an empty table gives
    empty tables; other columns, whatever their names, are ignored.
    """
    stage = Stage(documents.sparkSession)
    text = F.col("text")
    docs = with_text(documents, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))

    def runs(x: Column) -> Column:
        return F.size(F.split(x, r"\s+", -1)) - 1

    def broken(x: Column) -> Column:
        """Length up to the end of the last white space, null where there is none."""
        return F.when(x.rlike(r"\s"), F.length(x) - F.length(F.element_at(F.split(x, r"\s", -1), -1)))

    none = F.array().cast("array<struct<gap:int,val:string,runs:int,broken:int>>")
    found = []
    for kind, pattern in KINDS.items():
        may = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]")
        cut = F.transform(
            matches(text, pattern),
            lambda z: F.struct(F.length(z["gap"]).alias("gap"), z["val"].alias("val"), runs(z["gap"]).alias("runs"), broken(z["gap"]).alias("broken")),
        )
        found.append(F.when(may, cut).otherwise(none).alias(kind))
    kept = stage.keep(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *found), "matches", **PACKED)

    # places of matches: gaps and matches before them, summed within the row; runs of white space before them number the token
    here = Window.partitionBy("row", "kind").orderBy("at")
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in KINDS])
    each = kept.select("row", F.explode(listed).alias("k")).select("row", "k.kind", F.posexplode("k.found").alias("at", "m"))
    each = each.select("row", "kind", "at", "m.*", F.coalesce(F.length("val"), F.lit(0)).alias("size"), F.coalesce(runs(F.col("val")), F.lit(0)).alias("inner"))
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(here)).withColumn("start", F.col("end") - F.col("size"))
    each = each.withColumn("last", F.sum(F.col("runs") + F.col("inner")).over(here)).withColumn("first", F.col("last") - F.col("inner"))
    each = each.withColumn("in", F.col("start") + broken(F.col("val")))
    before = F.coalesce(F.greatest(F.max(F.col("start") - F.col("gap") + F.col("broken")).over(here), F.max("in").over(here.rowsBetween(Window.unboundedPreceding, -1))), F.lit(0))
    each = each.withColumn("head", F.col("start") - before).withColumn("tail", F.col("end") - F.coalesce("in", before))
    each = each.withColumnRenamed("val", "value").where("value is not null")
    base = each.where(valid(F.col("kind"), F.col("value"))).select(
        "row", "kind", F.col("start").cast("long"), F.col("end").cast("long"), "value", *[F.col(c).cast("int") for c in ("first", "last", "head", "tail")]
    )
    base = stage.keep(base, "base")

    spans = base.groupBy("row").agg(
        F.collect_list(F.struct("value", "first", "last", "head", "tail")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last")))).alias("taken"),
    )
    # only texts with base spans are joined to them
    def right(kind: str) -> Column:
        return F.exists(kind, lambda z: F.coalesce(valid(F.lit(kind), z["val"]), F.lit(False)))

    held = F.greatest(*map(right, KINDS))
    rows = kept.where(held).select("row", "doc_id", "text").join(spans.hint("shuffle_hash"), "row", "left")
    rows = rows.unionByName(kept.where(~held).select("row", "doc_id", "text"), allowMissingColumns=True)
    rows = stage.keep(rows, "rows", **PACKED)
    stage.drop(kept)
    def cut(t: DataFrame, *more: str, which: str = "vw") -> DataFrame:
        """Words, and hashes w of all words and v of their cores, by token."""
        low = F.transform(F.split(F.lower("text"), r"\s+", -1), lambda x: F.when(x != "", F.xxhash64(x)))
        bare = F.transform(F.split("text", r"\s+", -1), lambda x: F.when(x.rlike(r"^[\p{L}\p{N}]+$"), x).otherwise(F.regexp_replace(x, f"{LEAD}|{TRAIL}", "")))
        # a generator keeps the arrays from being made again wherever they are named
        arrays = {"v": F.transform(bare, coded), "w": low}
        return t.select("row", *more, F.inline(F.array(F.struct(*[arrays[c].alias(c) for c in which]))))

    free = F.when(F.col("taken").isNull(), F.col("v")).otherwise(F.transform("v", lambda x, i: F.when(~F.array_contains("taken", i), x)))

    def edge(s: Column) -> Column:
        """A base span's hash and patterns; what is joined to it counts as a word if it has letters or digits."""
        def glued(x: Column) -> Column:
            return F.when(x.rlike(r"[\p{L}\p{N}]"), F.xxhash64(F.lower(x)))

        front = glued(F.substring(F.get("words", s["first"]), F.lit(1), s["head"]))
        behind = glued(F.substring(F.get("words", s["last"]), s["tail"] + 1, F.lit(2**31 - 1)))
        one, two = (F.get("w", s["first"] - k) for k in (1, 2))
        near, far = F.coalesce(front, one), F.when(front.isNotNull(), one).otherwise(two)
        return F.struct(coded(s["value"]).alias("v"), F.array_compact(F.array(*each_pattern(near, far, F.coalesce(behind, F.get("w", s["last"] + 1))))).alias("ps"))

    # the arrays of texts with base spans are written once, as each span looks into them
    held = cut(rows.where("spans is not null").withColumn("words", F.split("text", r"\s+", -1)), "spans", "words", which="w")
    held = stage.keep(held, "held", **PACKED)
    seeds = held.select(F.explode(F.transform("spans", edge)).alias("e")).select("e.v", F.explode_outer("e.ps").alias("p"))
    units, shaped = (cut(t, "taken").select("row", free.alias("v"), "w") for t in (rows, rows.where(text.rlike(SECRET_PART))))
    reached = stage.keep(learn(stage, units, seeds, shaped), "learned")
    stage.drop(held)

    # tokens of learned values, and their places in the texts that hold one
    alone = cut(rows, "taken", which="v").select("row", F.posexplode(free).alias("at", "v"))
    toks = alone.where(sieve(reached, "v")(F.col("v"))).join(few(reached), "v", "left_semi")
    toks = stage.keep(toks.select("row", "at"), "tokens")
    here = Window.partitionBy("row").orderBy("at")
    held = rows.select("row", "text").join(few(toks.select("row").distinct()), "row", "left_semi")
    parts = held.select("row", text.rlike(r"^\s").cast("int").alias("_first"), F.posexplode(matches(text, r"\S+")).alias("at", "m"))
    end = F.sum(F.length("m.gap") + F.coalesce(F.length("m.val"), F.lit(0))).over(here)
    parts = parts.select("row", (F.col("at") + F.col("_first")).alias("at"), end.cast("long").alias("end"), F.col("m.val").alias("token")).where("token is not null")
    value, lead = F.regexp_replace("token", f"{LEAD}|{TRAIL}", ""), F.length(F.regexp_extract("token", LEAD, 0))
    start = F.col("end") - F.length("token") + lead
    learned = parts.join(toks, ["row", "at"], "left_semi").select(
        "row", F.lit("id").alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.lit(False).alias("base")
    )
    base = base.select("row", "kind", "start", "end", "value")
    return rows.select("row", "doc_id"), base.withColumn("base", F.lit(True)).unionByName(learned)


def span_digests(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_learned, n_spans, base_sha256, spans) of each row."""
    order = F.create_map(*[x for i, k in enumerate([*KINDS, "id"]) for x in (F.lit(k), F.lit(i))])[F.col("kind")]
    one = F.struct(order.alias("o"), "start", "end", "kind", "base")
    per = spans.groupBy("row").agg(
        F.sort_array(F.collect_list(one)).alias("all"),
        *[F.count(F.when((F.col("kind") == k) & F.col("base"), 1)).alias(f"n_{k}") for k in KINDS],
        F.count(F.when(~F.col("base"), 1)).alias("n_learned"), F.count("*").alias("n_spans"),
    )

    def text(which: Column) -> Column:
        return F.concat_ws(",", F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    per = per.select(
        "row", *[f"n_{k}" for k in KINDS], "n_learned", "n_spans", text(F.filter("all", lambda s: s["base"])).alias("b"), text(F.col("all")).alias("spans")
    )
    return rows.join(per, "row", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in (*KINDS, "learned", "spans")],
        F.sha2(F.coalesce("b", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
