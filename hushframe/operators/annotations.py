"""Marks for viewers: where restored tokens and calculated results stand in the text that a user sees.

The text that is kept holds a token for all that was replaced, a CALC token for each result included, so it maps every
place of the final text: a token's place there is the length of all that comes before it, each token at the length of what
it shows. One prefix sum over the tokens of a text gives all spans, however many replacements led to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions import grammar, taxonomy

#: What an annotation says, in the order of its fields.
FIELDS = ("start", "end", "annotation_type", "placeholder", "text", "entity_type", "severity", "canonical", "aliases", "value", "formula")


def known_tokens(entities: DataFrame) -> DataFrame:
    """The vault as what tokens show: (session, token, shown, entity_type, canonical, aliases, value)."""
    none = F.lit(None)
    value = F.coalesce(F.col("value").cast("double"), none)
    aliases = F.coalesce("aliases", F.array("canonical"))
    kind = F.coalesce("entity_type", grammar.placeholder_type(F.col("placeholder")))
    columns = ("session", F.col("placeholder").alias("token"), F.col("canonical").alias("shown"), kind.alias("entity_type"), "canonical", aliases.alias("aliases"))
    return entities.select(*columns, value.alias("value"))


def known_results(done: DataFrame) -> DataFrame:
    """Calculations of answers (session, turn, computations) as what their tokens show, each token of a session once; columns as of `known_tokens`."""
    rows = done.select("session", F.explode("computations").alias("c"))
    rows = rows.groupBy("session", F.col("c.placeholder").alias("token")).agg(F.min(F.struct(F.col("c.formatted").alias("shown"), F.col("c.result").alias("value"))).alias("f"))
    shown = F.col("f.shown")
    columns = ("session", "token", shown.alias("shown"), F.lit("calc").alias("entity_type"), shown.alias("canonical"), F.array().cast("array<string>").alias("aliases"))
    return rows.select(*columns, F.col("f.value").alias("value"))


def own_results(done: DataFrame) -> DataFrame:
    """(session, turn, token, snippet, formula): what each answer calculated, new or once more."""
    rows = done.select("session", "turn", F.explode("computations").alias("c"))
    first = F.min(F.struct(F.col("c.snippet").alias("snippet"), F.col("c.resolved").alias("formula"))).alias("f")
    return rows.groupBy("session", "turn", F.col("c.placeholder").alias("token")).agg(first).select("session", "turn", "token", "f.*")


def spans(texts: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Every token of texts(session, turn, text) with its span in the final text: (session, turn, nth, token, start, end, ...columns of `known`).

    start and end count UTF-16 units, as viewers do, from 0, end exclusive. Tokens that nothing is known of show themselves. Texts of
    a session have turns of their own; null sessions and turns are values like others.
    """
    return _spans(texts, known, text).drop("_k")


def _text_key() -> Column:
    """A text's session and turn as one value that is never null, by which all that a text needs comes together in one shuffle."""
    return F.struct(F.col("session").alias("session"), F.col("turn").alias("turn")).alias("_k")


def _spans(texts: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    found = F.regexp_extract_all(F.col(text), F.lit(f"({grammar.PLACEHOLDER})"), F.lit(1))
    before = F.transform(F.split(F.col(text), grammar.PLACEHOLDER, -1), grammar.utf16_length)
    tokens = F.zip_with(found, F.slice(before, F.lit(1), F.size(found)), lambda t, n: F.struct(t.alias("token"), n.alias("gap")))
    rows = texts.select("session", "turn", F.posexplode(tokens).alias("nth", "t")).select("session", "turn", _text_key(), "nth", "t.token", "t.gap")
    told = known.withColumnsRenamed({"session": "_s", "token": "_t"})
    joined = rows.join(told, rows["session"].eqNullSafe(F.col("_s")) & (rows["token"] == F.col("_t")), "left").drop("_s", "_t")
    long = grammar.utf16_length(F.coalesce("shown", "token"))
    order = Window.partitionBy("_k").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + long).over(order)
    return joined.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - long).drop("gap")


def annotations(texts: DataFrame, entities: DataFrame, done: DataFrame, repeats: bool = False) -> DataFrame:
    """Annotations of kept texts(session, turn, text): (session, turn, annotations), an array by start, then end; none for a text without any.

    entities: the vault; done: answers with their computations, as of `calc.apply`, of all turns whose tokens texts may hold. A
    result that this answer calculated, new or once more, is a local computation, marked where it is first shown (repeats: everywhere);
    other tokens are entities, results of other answers among them. Tokens without a meaning are not marked.
    """
    known = known_tokens(entities).unionByName(known_results(done))
    rows = _spans(texts, known).filter(F.col("shown").isNotNull() & (F.col("shown") != F.col("token")))
    # What an answer calculated comes as one array, by the key that its tokens lie by already.
    mine = own_results(done).groupBy(_text_key()).agg(F.collect_list(F.struct("token", "snippet", "formula")).alias("_mine"))
    rows = rows.join(mine, "_k", "left").withColumn("_own", F.get(F.filter("_mine", lambda m: m["token"] == F.col("token")), 0))
    rows = rows.select("*", "_own.snippet", "_own.formula").drop("_mine", "_own")
    own = F.col("snippet").isNotNull()
    if not repeats:
        nth = F.row_number().over(Window.partitionBy("_k", "token").orderBy("nth"))
        rows = rows.withColumn("_nth", nth).filter(~own | (F.col("_nth") == 1))
    local = lambda mine, other: F.when(own, mine).otherwise(other)
    kind, severity = F.col("entity_type"), taxonomy.severity_of(F.col("entity_type"))
    values = {
        "annotation_type": local(F.lit("local_computation"), F.lit("entity")),
        "placeholder": local(F.concat(F.lit("<python_snippet_"), F.col("snippet").cast("string"), F.lit(">")), F.col("token")),
        "text": F.col("shown"),
        "entity_type": local(F.lit("local_computation"), kind),
        "severity": local(F.lit("low"), severity),
        "formula": local(F.col("formula"), F.lit(None)),
    }
    one = F.struct(*[values.get(f, F.col(f)).alias(f) for f in FIELDS])
    return rows.groupBy("_k").agg(F.array_sort(F.collect_list(one)).alias("annotations")).select("_k.session", "_k.turn", "annotations")


def of_text(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """texts(session, turn, ...) with their annotations, an empty array for those without."""
    empty = F.array().cast(dict(marks.dtypes)["annotations"])
    own = marks.withColumnsRenamed({"session": "_s", "turn": "_t"})
    joined = texts.join(own, texts["session"].eqNullSafe(F.col("_s")) & texts["turn"].eqNullSafe(F.col("_t")), "left").drop("_s", "_t")
    return joined.withColumn("annotations", F.coalesce("annotations", empty))


def cut(text: Column, start: Column, end: Column) -> Column:
    """What stands between two UTF-16 places of a text."""
    wide = F.encode(text, "UTF-16LE")
    return F.decode(F.substr(wide, (start * 2 + 1).cast("int"), ((end - start) * 2).cast("int")), "UTF-16LE")
