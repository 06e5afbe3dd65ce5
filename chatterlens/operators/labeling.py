"""Labeling comments with entity, aspect, opinion and sentiment.

Two ways: a lexicon, as column expressions or as a join, and a pluggable batch
scorer behind an Arrow UDF.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from chatterlens import schemas
from chatterlens.operators import skew
from chatterlens.functions import scalars as sc
from chatterlens.functions.labels import english_sentiment


class Entry(NamedTuple):
    phrase: str
    entity: str
    aspect: str
    opinion: str
    sentiment: str


# The sample lexicon of the test fixtures.
LEXICON = (
    Entry("the", "host", "Dàn cast", "the", "tích cực"),
    Entry("and", "show", "Kịch bản", "and", "tiêu cực"),
    Entry("und", "host", "Dàn dựng", "und", "tiêu cực"),
    Entry("die", "guest", "Khách mời", "die", "tích cực"),
    Entry("pour", "show", "Kịch bản", "pour", "trung tính"),
    Entry("les", "guest", "Khách mời", "les", "tích cực"),
    Entry("que", "venue", "Địa điểm", "que", "trung lập"),
    Entry("para", "ads", "Quảng cáo", "para", "tiêu cực"),
)
QUAD_FIELDS = ("entity", "aspect", "opinion", "sentiment")


# --- lexicon ----------------------------------------------------------------

def lexicon_labels(
    text: sc.Name, lexicon: Sequence[Entry] = LEXICON, max_quads: int | None = None,
) -> Column:
    """Quads of the lexicon phrases that occur as tokens, by phrase; with
    ``max_quads`` only the first of them. A narrow expression for a lexicon
    that is to be part of the plan; :func:`lexicon_join` takes a table."""
    entries = F.create_map(*[part for e in sorted(lexicon) for part in (
        F.lit(e.phrase),
        F.struct(*[F.lit(getattr(e, f)).alias(f) for f in QUAD_FIELDS], F.lit(1.0).alias("confidence")),
    )])
    hits = F.array_sort(F.array_distinct(
        F.filter(sc.tokens(text), lambda t: t.isin([e.phrase for e in lexicon]))))
    return F.transform(hits if max_quads is None else F.slice(hits, 1, max_quads), lambda phrase: entries[phrase])


def lexicon_join(
    comments: DataFrame, lexicon: DataFrame, max_quads: int | None = None,
    key: str = "comment_id", split: bool = False,
) -> DataFrame:
    """The same for a lexicon table of any size: distinct tokens joined on the
    phrase. Spark broadcasts the table while its size allows and otherwise
    shuffles; with ``split``, tokens that are too frequent for one task are
    found first and dealt over several."""
    words = sc.each(comments, F.array_distinct(sc.tokens("text")), "phrase", key)
    hits = skew.join(words, lexicon, ["phrase"]) if split else words.join(lexicon, "phrase")
    if max_quads is not None:
        order = Window.partitionBy(key).orderBy("phrase")
        hits = hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_quads)
    return hits.select(key, *QUAD_FIELDS)


def lexicon_frame(spark: SparkSession, lexicon: Sequence[Entry] = LEXICON) -> DataFrame:
    """The lexicon as a relation whose size the optimizer knows."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in e._asdict().items()]) for e in lexicon])
    return spark.range(1).select(F.inline(rows))


def with_lexicon_labels(comments: DataFrame, lexicon: Sequence[Entry] = LEXICON) -> DataFrame:
    return comments.withColumn("labels", lexicon_labels("text", lexicon).cast(schemas.LABELS))


def quad_rows(comments: DataFrame, lexicon: Sequence[Entry] = LEXICON, *keep: str) -> DataFrame:
    """One row per quad with the comment's id and any further columns."""
    columns = ("comment_id", *keep)
    return sc.each(comments, lexicon_labels("text", lexicon), "q", *columns).select(
        *columns, "q.entity", "q.aspect", "q.opinion",
        english_sentiment("q.sentiment").alias("sentiment"),
    )


# --- scorer behind a UDF ----------------------------------------------------

Quad = dict[str, object]
Scorer = Callable[[list[str]], list[list[Quad]]]

PREDICTION = T.StructType([
    T.StructField("labels", schemas.LABELS), T.StructField("error", T.StringType()),
])

# Executors need not have this package: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lexicon_scorer(lexicon: Sequence[Entry] = LEXICON, max_quads: int | None = None) -> Callable[[], Scorer]:
    """Loader of a scorer that looks phrases up; stands in for a neural model."""
    def load() -> Scorer:
        cut = re.compile(r"[^\W_]+")
        table = {e.phrase: {**e._asdict(), "confidence": 1.0} for e in lexicon}

        def score(texts: list[str]) -> list[list[Quad]]:
            return [
                [table[p] for p in sorted(table.keys() & set(cut.findall(text.lower())))[:max_quads]]
                for text in texts
            ]
        return score
    return load


def _score_batch(scorer: Scorer, texts: list[str]) -> list[tuple[list[Quad], str | None]]:
    """One call for the batch; if it fails, one per text, so that only the
    texts at fault carry an error."""
    try:
        return [(quads, None) for quads in scorer(texts)]
    except Exception as failure:
        if len(texts) == 1:
            return [([], f"{type(failure).__name__}: {failure}")]
        return [result for text in texts for result in _score_batch(scorer, [text])]


def _loaded(key: str, load: Callable[[], Scorer]) -> Scorer:
    """The scorer of a UDF, kept in the interpreter of the Python worker: this
    module's own globals are shipped anew with every task. Only the latest is
    kept, so that models don't pile up."""
    scorers = sys.__dict__.setdefault("_chatterlens_scorers", {})
    if key not in scorers:
        scorers.clear()
        scorers[key] = load()
    return scorers[key]


def loader_key(load: Callable[[], Scorer]) -> str:
    return hashlib.sha256(cloudpickle.dumps(load)).hexdigest()


def labeling_udf(load: Callable[[], Scorer]):
    """Arrow UDF from text to labels and error; the scorer is loaded once per
    Python worker and called with whole batches. Loaders that pickle alike
    share it, over queries and micro-batches too."""
    fields, key = [f.name for f in schemas.LABEL.fields], loader_key(load)

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _loaded(key, load)
        for texts in batches:
            results = _score_batch(scorer, ["" if t is None else t for t in texts])
            yield pd.DataFrame({
                "labels": [[{f: q.get(f) for f in fields} for q in quads] for quads, _ in results],
                "error": [error for _, error in results],
            })
    return predict


def label(comments: DataFrame, load: Callable[[], Scorer] | None = None, min_confidence: float = 0.0) -> DataFrame:
    """Comments with ``labels`` and ``error`` from the scorer."""
    predict = labeling_udf(load or lexicon_scorer())
    scored = comments.withColumn("prediction", predict("text"))
    kept = F.filter("prediction.labels", lambda q: q["confidence"] >= min_confidence)
    return scored.withColumns({
        "labels": kept, "error": F.col("prediction.error"),
    }).drop("prediction")


def run_labeling(
    spark: SparkSession, input_path: str, output_path: str | None = None, mode: str = "file",
    limit: int | None = None, load: Callable[[], Scorer] | None = None,
) -> DataFrame | None:
    """Read JSON lines, label, then write them (``file``), print some
    (``console``) or hand them back, with ``limit`` the first by id (``memory``)."""
    from chatterlens.sources import readers

    result = label(readers.json_lines(spark, input_path, "id string, text string"), load)
    if mode == "file":
        result.write.mode("overwrite").json(output_path)
        return None
    if mode == "console":
        result.show(20, truncate=False)
        return None
    return result if limit is None else result.orderBy("id", "text").limit(limit)
