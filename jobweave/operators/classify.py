"""Field classification by keywords, with a model's answers where there are any."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.config import EXCLUDE_TERMS, HIGH_SIGNAL_TERMS, INCLUDE_TERMS, TAG_TERMS
from jobweave.functions.keywords import present, tagged, those
from jobweave.functions.text import collapse
from jobweave.schemas import CLASSIFICATION


def classify(
    postings: DataFrame, title: str = "title", text: str = "text", model: Column | None = None, include: tuple[str, ...] = INCLUDE_TERMS,
    exclude: tuple[str, ...] = EXCLUDE_TERMS, high: tuple[str, ...] = HIGH_SIGNAL_TERMS, tag_terms: dict[str, tuple[str, ...]] = TAG_TERMS,
) -> DataFrame:
    """Postings with decision (include, exclude or ambiguous), fits, fit_score, fields and reason.

    Included: a term of the first list and none of the second.  Excluded: none of the first and one of the
    second in the title.  Anything else is ambiguous and takes the model's answer (a CLASSIFICATION struct
    column) where it is not null, else fits by the terms of the first list alone.  The reasons are fixed values.
    """
    body = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    # One scan of the text for the terms of all lexicons, and one of the title.
    terms = tuple(dict.fromkeys((*include, *exclude, *(t for ts in tag_terms.values() for t in ts))))
    seen = postings.withColumn("_body", present(body, terms)).withColumn("_head", present(F.coalesce(title, F.lit("")), exclude))
    m = seen.withColumn("_in", those(F.col("_body"), include)).withColumn("_out", those(F.col("_body"), exclude)).withColumn("_title", those(F.col("_head"), exclude))
    some, none = F.size("_in") > 0, F.size("_in") == 0
    decision = F.when(some & (F.size("_out") == 0), "include").when(none & (F.size("_title") > 0), "exclude").otherwise("ambiguous")
    score = F.least(F.lit(95), F.when(F.arrays_overlap("_in", F.array(*[F.lit(t) for t in high])), 85 + 3 * F.size("_in")).otherwise(70 + 4 * F.size("_in")))
    listed = lambda head, c: F.concat(F.lit(head), F.array_join(c, ", "))
    fields = tagged(F.col("_body"), tag_terms)
    answer = lambda fits, fit, tagged, reason: F.struct(fits.alias("fits"), tagged.alias("fields"), fit.cast("int").alias("fit_score"), reason.alias("reason"))
    nothing = F.array().cast("array<string>")
    fallback = answer(
        some, F.when(some, 60).otherwise(0), fields,
        F.when(some, listed("Ambiguous keyword match without LLM fallback: ", "_in")).otherwise("No clear social-studies match and LLM fallback unavailable"),
    )
    ambiguous = fallback if model is None else F.coalesce(model, fallback)
    result = (
        F.when(F.col("decision") == "include", answer(F.lit(True), score, fields, listed("Matched social-studies terms: ", "_in")))
        .when(F.col("decision") == "exclude", answer(F.lit(False), F.lit(0), nothing, listed("Matched excluded role terms: ", "_title")))
        .otherwise(ambiguous)
    )
    out = m.withColumn("decision", decision).withColumn("_c", result)
    return out.select(*postings.columns, "decision", "_c.fits", "_c.fit_score", "_c.fields", "_c.reason")


def model_guard(answer: Column, tag_terms: dict[str, tuple[str, ...]] = TAG_TERMS) -> Column:
    """A model's answer with its score rounded into 0 to 100 and only known tags; null stays null."""
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(answer["fit_score"] + 0.5)))
    known = F.array_intersect(answer["fields"], F.array(*[F.lit(t) for t in tag_terms]))
    return F.when(answer.isNotNull(), F.struct(answer["fits"].alias("fits"), known.alias("fields"), score.cast("int").alias("fit_score"), answer["reason"].alias("reason")))


def evidence_guard(value: Column, quote: Column, text: Column, least: int = 8) -> Column:
    """A value that a model took from a text, if the quote that it gives stands there (white space and case aside)."""
    q, t = F.lower(collapse(quote)), F.lower(collapse(text))
    return F.when((F.length(q) >= least) & F.contains(t, q), value)


def evidenced(url: Column, html: Column, text: Column) -> Column:
    """Whether an address stands in the page or the text, case and one slash at its end aside."""
    bare = F.lower(F.regexp_replace(url, r"/\z", ""))
    hay = F.lower(F.replace(F.concat(F.coalesce(html, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))), F.lit("&amp;"), F.lit("&")))
    return (bare != "") & F.contains(hay, bare)


def url_guard(url: Column, html: Column, text: Column) -> Column:
    """An address that a model gave, if it stands in the page or the text."""
    return F.when(evidenced(url, html, text), url)


def with_model(postings: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], columns: tuple[str, ...], schema: T.StructType = CLASSIFICATION, name: str = "model") -> DataFrame:
    """Postings with a struct column of a model's answers.

    ``predict`` takes a batch with ``columns`` and gives as many rows with the schema's fields; a batch
    for which it raises, and rows that it answers with null, stay without answer.
    """
    rows = postings.drop(name)
    out = T.StructType([*rows.schema.fields, T.StructField(name, schema)])
    fields = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                got = predict(batch[list(columns)])
                answers = [None if r[fields[0]] is None else dict(zip(fields, (r[f] for f in fields), strict=True)) for r in got.to_dict("records")]
            except Exception:  # an external model may fail in any way; the rules then decide
                answers = [None] * len(batch)
            yield batch.assign(**{name: pd.Series(answers, index=batch.index, dtype=object)})

    return rows.mapInPandas(run, out)
