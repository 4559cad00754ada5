"""Benchmark decontamination by template windows, in DataFrame functions only.

A text is cut once into tokens: numbers (with a unit after them: quantities), names (runs of capitalised words,
wherever they stand, function words apart) and other words.  Numbers, quantities and names become typed
placeholders, everything else its lower-case word.  Windows of ``width`` template tokens of the benchmark and of
the corpus meet in a hash join; a window in which placeholders prevail is hashed with the values they stand for.
Windows of one document that lie on one alignment with a benchmark item are then taken together, and their slots
compared: where the values of the item answer to those of the document one to one, the passage is the item,
re-parameterised or verbatim.  Alignments whose slots contradict each other are not reported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.rows import of_ids, steady

WIDTH = 8
#: items of fewer tokens are matched with whole documents and whole lines only
SHORT = 4
#: windows of the benchmark (16 bytes each), and bytes of its texts, that a broadcast may hold
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 1 << 25
#: parts that the windows of one hash are dealt over where they are too many to broadcast
DEAL = 16

# Units after which a number is a quantity, function words that are no names, and the placeholders.
UNITS = """km cm mm kg mg ml m g l s h min hour hours minute minutes second seconds day days week weeks month months year years
    mile miles feet inch inches pound pounds dollar dollars euro euros cent cents usd eur percent""".split()
FUNCTION_WORDS = """a an the this that these those it its he she they we you i in on at by for from of to with as if when while where
    who whose what which why how is are was were do does did can could will would should must has have had there and or but so not no
    all each every some any given suppose find
    der die das ein eine einen dem den des und oder aber wenn wie was wer wo warum im am auf für mit von zu bei nach aus ist sind war es er
    sie wir ihr ich nicht
    le la les un une du de et ou mais si quand que qui où dans sur avec pour par est sont il elle ils elles nous vous je ce cette ces
    el los las una unos y o pero cuando qué quién dónde cómo por en con para del son él ella ellos""".split()
SLOTS = {"quantity": "ⓠ", "number": "ⓝ", "name": "ⓜ"}
#: every repeat is possessive or over one class of characters, so a text of any length is read in one pass
TOKEN = r"[0-9](?:[0-9.,:/-]*[0-9])?[%$€£°]?|\p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)*+|[a-z\p{L}\p{M}\p{Nd}]++"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _is_number(t: Column) -> Column:
    return (t >= "0") & (t < ":")


def tokens(text: Column) -> Column:
    """The tokens of a text as written, a number and the unit after it as one; null gives an empty array."""
    unit = lambda t: F.lower(t).isin(UNITS)

    def merge(raw: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            after = F.get(raw, i + 1)
            taken = (i > 0) & unit(t) & _is_number(F.get(raw, i - 1))
            return F.when(_is_number(t) & unit(after), F.concat_ws(" ", t, after)).when(~taken, t)

        return F.filter(F.transform(raw, one), lambda t: t.isNotNull())

    raw = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.coalesce(_let(raw, lambda r: F.when(text.rlike("[0-9]"), merge(r)).otherwise(r)), F.array().cast("array<string>"))


def template(raw: Column) -> Column:
    """The template of the tokens of a text: placeholders and lower-case words."""

    def one(t: Column, low: Column) -> Column:
        name = t.rlike(r"^\p{Lu}\p{Ll}") & ~low.isin(FUNCTION_WORDS)
        number = F.when(t.rlike("[0-9]$"), SLOTS["number"]).otherwise(SLOTS["quantity"])
        same = F.when(_is_number(t), number).otherwise(low)
        return F.when(t == low, same).otherwise(F.when(name, SLOTS["name"]).otherwise(F.when(_is_number(t), number).otherwise(low)))

    return _let(raw, lambda r: F.zip_with(r, F.transform(r, F.lower), one))


_ARTICLES = f"^(?:(?:{'|'.join(FUNCTION_WORDS)}) )++"


def values(raw: Column) -> Column:
    """What every token says, in lower case; a name without the function words that lead its run."""
    return F.transform(raw, lambda t: F.when(t.rlike(r"^\p{Lu}\p{Ll}"), F.regexp_replace(F.lower(t), _ARTICLES, "")).otherwise(F.lower(t)))


def _spread(array: Column, n: int, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` over every ``n`` consecutive elements, by doubling; shorter arrays give none."""

    def pair(x: Column, y: Column, k: int) -> Column:
        return F.zip_with(x, F.slice(y, F.lit(k + 1), F.size(y)), join)

    def grow(x: Column, at: int, rest: Column | None, done: int) -> Column:
        """``x`` spans ``at`` elements, ``rest`` the ``done`` first ones of the window."""
        if n & at:
            now = x if rest is None else pair(rest, x, done)
            if done + at == n:
                return now
            return _let(now, lambda r: _let(pair(x, x, at), lambda y: grow(y, 2 * at, r, done + at)))
        return _let(pair(x, x, at), lambda y: grow(y, 2 * at, rest, done))

    whole = _let(array, lambda x: grow(x, 1, None, 0))
    return F.when(F.size(array) >= n, F.slice(whole, F.lit(1), F.greatest(F.size(array) - n + 1, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def _heavy(t: Column, n: int) -> Column:
    """Where the windows of ``n`` tokens begin in which placeholders prevail: found from the places of the placeholders alone."""
    need = n // 2 + 1

    def starts(p: Column) -> Column:
        last = lambda j: F.get(p, j + (need - 1))
        near = F.transform(p, lambda x, j: F.when(last(j) - x < n, F.sequence(F.greatest(last(j) - (n - 1), F.lit(0)), F.least(x, F.size(t) - n))))
        return F.array_distinct(F.flatten(F.filter(near, lambda x: x.isNotNull())))

    places = F.filter(F.transform(t, lambda x, i: F.when(x.isin(*SLOTS.values()), i)), lambda i: i.isNotNull())
    return F.when(F.size(t) >= n, _let(places, starts)).otherwise(F.array().cast("array<int>"))


def _windows(rows: DataFrame, raw: Column, n: int, by_value: bool, *keep: str, known: bool = False) -> DataFrame:
    """(keep, at, hash): the windows of ``n`` of the tokens ``raw``; with ``by_value`` also, hashed with their values, those
    in which placeholders prevail.  Of the benchmark's own (``known``) windows those are hashed in that way only."""
    kind = "array<struct<at:int,hash:bigint>>"

    def hashed(at: Column, h: Column) -> Column:
        return F.struct(at.alias("at"), h.alias("hash"))

    def plain(t: Column, heavy: Column) -> Column:
        h = _spread(F.transform(t, lambda x: F.xxhash64(x)), n, lambda a, b: F.xxhash64(a, b))
        if not known:
            return F.transform(h, lambda x, i: hashed(i, x))
        every = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(F.array().cast("array<int>"))
        return _let(h, lambda x: F.transform(F.array_except(every, heavy), lambda i: hashed(i, F.get(x, i))))

    def exact(r: Column, heavy: Column) -> Column:
        some = _let(values(r), lambda v: F.transform(heavy, lambda i: hashed(i, F.xxhash64(F.slice(v, i + 1, F.lit(n)), F.lit("exact")))))
        return F.when(F.size(heavy) > 0, some).otherwise(F.array().cast(kind))

    def both(r: Column, t: Column) -> Column:
        return _let(_heavy(t, n), lambda heavy: F.concat(plain(t, heavy), exact(r, heavy))) if by_value else plain(t, F.array().cast("array<int>"))

    found = _let(raw, lambda r: _let(template(r), lambda t: both(r, t)))
    return rows.select(*keep, F.explode_outer(found).alias("w")).select(*keep, "w.at", "w.hash").where("hash is not null")


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, raw, size) of every item as written and in lower case, ``item`` telling the texts apart."""
    item = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    item = item.select("item_id", F.explode(F.array_distinct(F.array("text", F.lower("text")))).alias("text"))
    item = item.select("item_id", F.xxhash64("item_id", "text").alias("item"), tokens(F.col("text")).alias("raw"))
    return steady(item.select("*", F.size("raw").alias("size")).where("size > 0"))


def _whole(doc: DataFrame, item: DataFrame) -> DataFrame:
    """Documents that are, or hold as a line of their own, an item of fewer than ``SHORT`` tokens."""
    line = F.explode_outer(F.array_distinct(F.concat(F.array("text"), F.split("text", "\n")))).alias("line")
    said = doc.select("doc_id", line).select("doc_id", values(tokens(F.col("line"))).alias("said")).where(F.size("said").between(1, SHORT - 1))
    small = item.select("item_id", values(F.col("raw")).alias("said"), template(F.col("raw")).alias("t")).distinct()
    slots = F.size(F.array_distinct(F.filter(F.arrays_zip("t", "said"), lambda x: x["t"].isin(*SLOTS.values())))).cast("long")
    small = small.select("item_id", "said", slots.alias("slots"))
    few = small.count() <= BROADCAST_WINDOWS
    found = said.join(F.broadcast(small) if few else small, "said").groupBy("doc_id", "item_id").agg(F.max("slots").alias("n_slots"))
    return found.select("doc_id", "item_id", F.lit(1).cast("long").alias("n_windows"), F.lit(1.0).alias("coverage"), "n_slots", F.lit(True).alias("verbatim"))


def _hits(doc: DataFrame, item: DataFrame, width: int) -> DataFrame | None:
    """(doc_id, doc, item_id, item, n, doc_at, item_at) of every window that a document shares with an item."""
    lengths = sorted(r[0] for r in item.select(F.least("size", F.lit(width)).alias("n")).where(F.col("n") >= SHORT).distinct().collect())
    hits = None
    for n in lengths:
        own = item.where(F.col("size") == n if n < width else F.col("size") >= width)
        by_value = not own.where(F.size(_heavy(template(F.col("raw")), n)) > 0).isEmpty()
        known = _windows(own, F.col("raw"), n, by_value, "item_id", "item", known=True).withColumnRenamed("at", "item_at").distinct()
        there = _windows(doc, tokens(F.col("text")), n, by_value, "doc_id", "doc").withColumnRenamed("at", "doc_at")
        if known.count() <= BROADCAST_WINDOWS:
            found = there.join(F.broadcast(known), "hash")
        else:
            there = there.withColumn("part", F.pmod(F.xxhash64("doc", "doc_at"), F.lit(DEAL)))
            found = there.join(known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEAL - 1).cast("long")))), ["hash", "part"])
        found = found.select("doc_id", "doc", "item_id", "item", F.lit(n).alias("n"), "doc_at", "item_at")
        hits = found if hits is None else hits.unionAll(found)
    return hits


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: float = 0.5, run: int = 20) -> DataFrame:
    """Rows (doc_id, item_id, n_windows, coverage, n_slots, verbatim): documents that hold a benchmark item.

    A document holds an item when the windows on one alignment cover at least ``least`` of the item's windows, or
    ``run`` of them, and the slots between the first and the last agree: every value of the item answers to one
    value of the document, and for names every value of the document to one of the item too (two numbers may become
    equal by chance); or at least nine in ten slots say the same.  One row for each document and item, from the
    alignment with most windows (then the first).  Items of ``SHORT`` to ``width`` tokens are matched as a whole over
    windows of their own length; shorter ones with documents or lines that say just the same and nothing else.
    Windows of which over half are placeholders match only with equal values.  Items are also looked up in lower case,
    so copies without capitals are found.

    Null or empty texts, items without a word or number, and null ids match nothing; repeated rows count once, and
    texts that share a doc_id or an item_id are each looked at.  Texts of any length are read whole.  Other columns are not read.
    """
    doc = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    doc = doc.withColumn("doc", F.xxhash64("doc_id", "text"))
    item = _items(benchmark)
    nothing = doc.join(item, F.lit(False)).select("doc_id", "item_id", F.lit(0).cast("long").alias("n_windows"), F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("n_slots"), F.lit(True).alias("verbatim"))
    found = [] if item.where(F.col("size") < SHORT).isEmpty() else [_whole(doc, item.where(F.col("size") < SHORT))]
    hits = _hits(doc, item, width)
    if hits is not None:
        found.append(_consistent(doc, item, hits, least, run))
    if not found:
        return nothing.where("false")
    best = F.max_by(F.struct("n_windows", "coverage", "n_slots", "verbatim"), F.struct("n_windows", "coverage", "n_slots", "verbatim"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1]).groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def _consistent(doc: DataFrame, item: DataFrame, hits: DataFrame, least: float, run: int) -> DataFrame:
    """The best alignment of each document and item, of those that are long enough and whose slots agree."""
    key = ["doc_id", "doc", "item_id", "item", "n", "shift"]
    lines = hits.groupBy(*key[:-1], (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(
        F.count_distinct("item_at").alias("n_windows"), F.min("item_at").alias("a"), F.max("item_at").alias("b"))
    sizes = item.select("item", "size", "raw")
    few = item.agg(F.coalesce(F.sum(F.aggregate("raw", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))), F.lit(0))).first()[0] <= BROADCAST_BYTES
    if few:
        lines = lines.join(F.broadcast(sizes), "item")
    else:
        sizes = sizes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEAL - 1).cast("long"))))
        lines = lines.withColumn("part", F.pmod(F.col("doc"), F.lit(DEAL))).join(sizes, ["item", "part"])
    lines = lines.withColumn("coverage", F.col("n_windows") / (F.col("size") - F.col("n") + 1)).where((F.col("coverage") >= least) | (F.col("n_windows") >= run))
    length = (F.col("b") - F.col("a") + F.col("n")).cast("int")
    own = F.slice("raw", F.col("a") + 1, length)
    lines = steady(lines.select(*key, "n_windows", "coverage", "a", length.alias("length"), values(own).alias("x"), template(own).alias("kx")))

    there = of_ids(doc, steady(lines.select("doc").distinct()), "doc").dropDuplicates(["doc"]).select("doc", tokens(F.col("text")).alias("doc_raw"))
    slots = lines.join(there.hint("merge"), "doc").withColumn("own", F.slice("doc_raw", (F.col("a") + F.col("shift") + 1).cast("int"), F.col("length")))
    slots = slots.select("doc_id", "item_id", "shift", "n_windows", "coverage", F.arrays_zip("x", "kx", values(F.col("own")).alias("y"), template(F.col("own")).alias("ky")).alias("z"))
    known = list(SLOTS.values())
    slots = slots.withColumn("z", F.filter("z", lambda s: s["kx"].isin(*known) & s["ky"].isin(*known)))

    def distinct(fields: Callable[[Column], Column], of: Column) -> Column:
        return F.size(F.array_distinct(F.transform(of, fields)))

    z = F.col("z")
    names = F.filter(z, lambda s: s["ky"] == SLOTS["name"])
    pairs = distinct(lambda s: s, z)
    same = F.size(F.filter(z, lambda s: (s["x"] == s["y"]) & (s["kx"] == s["ky"])))
    one_way = pairs == distinct(lambda s: F.struct(s["kx"], s["x"]), z)
    other_way = distinct(lambda s: s, names) == distinct(lambda s: s["y"], names)
    judged = slots.select("doc_id", "item_id", "shift", "n_windows", "coverage", distinct(lambda s: F.struct(s["kx"], s["x"]), z).cast("long").alias("n_slots"),
        (same == F.size(z)).alias("verbatim"), ((one_way & other_way) | (same * 10 >= F.size(z) * 9)).alias("good"))
    best = F.max_by(F.struct("n_windows", "coverage", "n_slots", "verbatim"), F.struct("n_windows", -F.col("shift"), "coverage", "n_slots", "verbatim"))
    return judged.where("good").groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
