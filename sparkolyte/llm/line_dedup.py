"""Line dedup by content-defined chunks of lines, in DataFrame functions.

A rolling hash covers each line and the one before it. A boundary falls between two lines whose rolling hash did not
stand earlier, in any text before by (doc_id, hash of the text) or further up in its own; so boundaries depend on
the two lines beside them alone and text put in or cut out moves no other. Between boundaries lie chunks: single
lines, and runs of two lines or more all of whose neighbouring lines stood together before. Such multi-line chunks go,
after each two lines have been compared byte for byte with those that stood first. Pairs of white space alone count
for no chunk. So of every run of two lines or more that stood before all lines go, whatever stands around it, and each
line that goes has an equal one, earlier, that stays. A single line between others stays wherever it stands.

Cuts at local minima of the rolling hash, the usual choice, leave most short runs between unique lines in place, since
their first and last lines fall into one chunk with a neighbour; the README gives figures.

Null texts stay null. Rows that repeat a doc_id with the same text are cut alike; a null doc_id counts as the least. A
text of which nothing but white space is left becomes empty and has emptied = true. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared


def _bind(value: Column, f) -> Column:
    """f(value) with value worked out once, however often f uses it inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def pairs(text: Column) -> Column:
    """Each two neighbouring lines of the text, joined by a line feed."""
    two = lambda lines: F.transform(
        F.slice(lines, F.lit(1), F.size(lines) - 1), lambda x, i: F.concat(x, F.lit("\n"), F.get(lines, i + 1))
    )
    return _bind(_lines(text), two)


def _repeated(texts: DataFrame) -> DataFrame:
    """_doc, _text and _gone, the places of the pairs that stood before, of the texts that have any."""
    hashes = F.transform(pairs(F.col("text")), lambda c: F.when(c.rlike(r"\S"), F.xxhash64(c)))
    light = texts.where(F.contains("text", F.lit("\n"))).select("_doc", "_text", F.posexplode(hashes).alias("k", "h"))
    light = shared.materialize(light.where("h is not null").distinct(), "rolling_hashes")
    again = light.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    # A text's pairs that meet others by hash; their number is that of its lines at most.
    asked = shared.spread(light, again, ["h"], "_text").groupBy("_doc", "_text").agg(F.collect_list(F.struct("k", "h")).alias("asked"))
    asked = shared.materialize(asked, "asked")
    met = texts.join(asked.hint("merge"), ["_doc", "_text"]).dropDuplicates(["_doc", "_text"])
    pick = lambda all_: F.transform("asked", lambda a: F.struct(a["k"], a["h"], F.get(all_, a["k"]).alias("pair")))
    met = met.select("_doc", "_text", F.inline(_bind(pairs(F.col("text")), pick)))
    met = shared.materialize(met, "repeated_pairs")
    # Equal bytes are counted together before anything moves, so a frequent pair is a few rows.
    place = F.struct("_doc", "_text", "k")
    kinds = met.groupBy("h", "pair").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    kinds = shared.materialize(kinds, "equal_pairs")
    alike = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("first").alias("first"), F.sum("n").alias("n"))
    # A hash with one kind of bytes stands for them; of several kinds each is looked for by its bytes.
    one = alike.where("kinds = 1 and n > 1").select("h", "first")
    many = kinds.join(alike.where("kinds > 1").select("h"), "h").where("n > 1").select("h", "pair", "first")
    places = shared.spread(met.drop("pair"), one, ["h"], "_text").select("_doc", "_text", "k", "first")
    places = places.unionByName(shared.spread(met, many, ["h", "pair"], "_text").select("_doc", "_text", "k", "first"))
    return places.where(place != F.col("first")).groupBy("_doc", "_text").agg(F.collect_set("k").alias("_gone"))


def _cut(docs: DataFrame) -> DataFrame:
    """_row (all columns of docs), _new (the text cut), n_lines, n_removed, emptied."""
    shared.prepare(docs.sparkSession)
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_doc"),
        F.xxhash64("text").alias("_text"),
        "text",
    )
    gone = shared.materialize(_repeated(keyed.where("text is not null").select("_doc", "_text", "text")), "removed")
    joined = keyed.join(gone.hint("merge"), ["_doc", "_text"], "left")

    def result(lines: Column) -> Column:
        has = lambda k: F.array_contains("_gone", k)
        kept = F.filter(lines, lambda _, k: ~(has(k) | has(k - 1)))
        return F.struct(F.array_join(kept, "\n").alias("text"), F.size(lines).alias("n"), F.size(kept).alias("kept"))

    cut = F.when(F.col("_gone").isNotNull(), _bind(_lines(F.col("text")), result))
    out = joined.select("_row", "text", cut.alias("_cut"))
    blank = F.coalesce(~F.col("_cut.text").rlike(r"\S"), F.lit(False))
    whole = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(-1))
    return out.select(
        "_row",
        F.when(blank, "").when(F.col("_cut").isNotNull(), F.col("_cut.text")).otherwise(F.col("text")).alias("_new"),
        whole.cast("long").alias("n_lines"),
        F.coalesce(F.col("_cut.n") - F.col("_cut.kept"), F.lit(0)).cast("long").alias("n_removed"),
        blank.alias("emptied"),
    )


def _row(docs: DataFrame, own: tuple[str, ...] = ()) -> list[Column]:
    return [F.col("_new").alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c not in own]


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with text cut, and n_lines (-1 for null), n_removed, emptied; columns of those names in docs give way."""
    own = ("n_lines", "n_removed", "emptied")
    return _cut(docs).select(*_row(docs, own), *own)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without the lines of repeated runs and n_chars brought up to date; those left empty go."""
    columns = [F.length("_new").cast("long").alias(n) if n == "n_chars" else c for n, c in zip(docs.columns, _row(docs), strict=True)]
    return _cut(docs).where("not emptied").select(*columns)


SQL = """
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i
  from documents where text is not null
), paired as (
  select *, lead(line) over (partition by doc_id order by i) as after from lines
), stood as (
  select *, after is not null and regexp_matches(line || chr(10) || after, '\\S')
    and row_number() over (partition by line, after order by doc_id, i) > 1 as again
  from paired
), flagged as (
  select *, again or coalesce(lag(again) over (partition by doc_id order by i), false) as gone from stood
), texts as (
  select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '') as text,
    count(*) as n_lines, count(*) filter (where gone) as n_removed
  from flagged group by doc_id
)
select d.doc_id,
  case when t.n_removed > 0 and not regexp_matches(t.text, '\\S') then '' else t.text end as text,
  d.lang, d.source, d.n_chars, coalesce(t.n_lines, -1) as n_lines, coalesce(t.n_removed, 0) as n_removed,
  coalesce(t.n_removed > 0 and not regexp_matches(t.text, '\\S'), false) as emptied
from documents d left join texts t using (doc_id)
"""
