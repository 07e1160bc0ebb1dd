"""Images and texts covered together: what either side knows is looked for on the other.

The words that an engine recognised in an image are a text, sanitised as any turn is, and boxes, to be covered. Needles for
the boxes come from three sides: surfaces that the session's vault knows (from other turns, or just found in the text), items that a
detector saw in the picture, and words that are something by their form. What only the image holds gets a token of the
same vault, and is taken out of the text as well: a value can't stay on one side and go on the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import scalars, taxonomy
from hushframe.operators import turn_pipeline, vault_table, visual
from hushframe.sources.tables import keep, once, release


def _tag(label: Column) -> Column:
    """Tag of a visual label; of an unknown one its own name."""
    known = F.lit(None).cast("string")
    for name, tag in taxonomy.VISUAL_LABELS.items():
        known = F.when(label == name, F.lit(tag)).otherwise(known)
    return F.coalesce(known, F.upper(label))


def _label(tag: Column) -> Column:
    """Visual label of a token's tag, by the first label that has it; else the tag's own type."""
    known = F.lit(None).cast("string")
    for name, own in reversed(taxonomy.VISUAL_LABELS.items()):
        known = F.when(tag == own, F.lit(name)).otherwise(known)
    return F.coalesce(known, taxonomy.slug_of(tag))


def cover(images: DataFrame, words: DataFrame, entities: DataFrame, items: DataFrame | None = None, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts, boxes and the vault after them: images with sanitized and modified; (image, place, label, placeholder, left, top, right, bottom); entities.

    images: (image, session, turn, text), the text as recognised; words: as of `visual`; entities: the vault; items: (image,
    text, label) that a detector saw, none by default; found: entities found in the texts (with image as `_part`), by default those of `detect_turns`.
    A box stands for one place of one needle, as `visual.regions` takes them. Images without words, and words without an image, give no boxes.
    """
    words = once(words)
    rows = images.select("session", "turn", F.col("image").alias(turn_pipeline.PART), "text")
    first, known = turn_pipeline.sanitize(rows, entities, found)
    seen = visual.word_forms(words, "image").select("image", F.col("value").alias("text"), "label", F.col("place").cast("long").alias("place"))
    if items is not None:
        seen = seen.unionByName(items.select("image", F.trim("text").alias("text"), "label", F.lit(0).cast("long").alias("place")).filter("text <> ''"))
    value = seen.groupBy("image", "text", "label").agg(F.min("place").alias("place"))
    value = keep(value.join(images.select("image", "session", "turn"), "image"))
    # What only the picture holds is minted by the vault of the session, and leaves the text as well.
    kind = taxonomy.slug_of(_tag(F.col("label"))).alias("entity_type")
    asked = value.groupBy("session", "turn", F.col("image").alias(turn_pipeline.PART), F.col("text").alias("entity_text")).agg(F.min(F.struct("place", "label")).alias("_f"))
    asked = asked.select("session", "turn", turn_pipeline.PART, "entity_text", F.col("_f.place").alias("detect_rank"), F.col("_f.label").alias("label"))
    asked = asked.select("session", "turn", turn_pipeline.PART, "entity_text", "detect_rank", F.lit(0).alias("source_rank"), kind)
    again = keep(first.select("session", "turn", turn_pipeline.PART, F.col("text").alias("_said"), F.col("sanitized").alias("text")))
    second, after = turn_pipeline.sanitize(again, known, asked)
    texts = second.select(F.col(turn_pipeline.PART).alias("_image"), "sanitized", (F.col("sanitized") != F.col("_said")).alias("modified"))
    done = images.join(texts, images["image"].eqNullSafe(F.col("_image")), "left").drop("_image")
    needles = keep(_needles(images, value, after))
    boxes = visual.match_needles(words, needles.select("image", "needle", "tokens"), "image")
    named = needles.select("image", "needle", "label", "placeholder")
    covered = keep(boxes.join(named, ["image", "needle"]).select("image", F.col("first").alias("place"), "label", "placeholder", *visual.BOX).distinct())
    release(value, needles)
    return done, covered, after


def _needles(images: DataFrame, value: DataFrame, entities: DataFrame) -> DataFrame:
    """(image, needle, tokens, label, placeholder): known surfaces that an image's text holds, and what may be looked for of the values seen in it."""
    surfaces = vault_table.surfaces(entities).select(F.col("session").alias("_s"), F.col("surface"), "placeholder")
    within = images["session"].eqNullSafe(F.col("_s")) & F.contains("text", F.col("surface"))
    tag = F.regexp_extract("placeholder", r"<<(.*)_\d+>>", 1)
    said = images.join(surfaces, within).select("image", F.col("surface").alias("text"), _label(tag).alias("label"), "placeholder")
    told = vault_table.lookup(value.select("image", "session", F.col("text").alias("surface"), "label"), entities)
    parts = F.explode(F.array_union(F.array("surface"), visual.needle_candidates(F.col("surface"), F.col("label"))))
    shown = told.select("image", parts.alias("text"), "label", "placeholder")
    every = said.unionByName(shown).filter(F.col("placeholder").isNotNull()).withColumn("tokens", scalars.filtered(scalars.ocr_tokens(F.col("text"))))
    every = every.filter(F.size("tokens") > 0).groupBy("image", "placeholder", "tokens").agg(F.min("label").alias("label"))
    return every.select("image", F.concat_ws(" ", "placeholder", F.array_join("tokens", " ")).alias("needle"), "tokens", "label", "placeholder")
