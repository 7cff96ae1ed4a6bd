"""Words, features, models and chunks."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from cohortloom.catalog.coverage import silver
from cohortloom.catalog.labelling import target
from cohortloom.catalog.registry import TOP_K, query
from cohortloom.functions import text as tx
from cohortloom.operators import chunks as ch
from cohortloom.operators import features as fx
from cohortloom.operators import labels as lb
from cohortloom.operators import metrics as mx
from cohortloom.operators import model as md
from cohortloom.operators import scores as sc
from cohortloom.operators import splits as sp
from cohortloom.params import FeatureParams, ModelParams
from cohortloom.session import cut_lineage, fresh_path
from cohortloom.sources.stages import StagePaths
from cohortloom.streaming import jobs

MIN_DF, MAX_FEATURES = 5, 5000

# A model reads the whole vocabulary.
FULL = FeatureParams()


@query("tokenize_words", "SELECT note_id, array_to_string(w, ' ') AS words, len(w) AS n FROM words")
def _(t):
    words = t.texts.select("note_id", tx.tokenize_words(F.col("text")).alias("w"))
    return words.select("note_id", F.array_join("w", " ").alias("words"), F.size("w").alias("n"))


# Characters that fold to one or several others, in and beyond the basic plane, and their words.
FOLDED = "Café ﬁne ½x ⑩⑪ ﷺ 한글 각 𝐀𝐛𝟏 ㍿ Ｆｕｌｌ ǆa Ⅷi"
FOLDED_WORDS = [
    "cafe", "fine", "2x", "1011", "صلى", "الله", "عليه", "وسلم", "\u1112\u1161\u11ab\u1100\u1173\u11af",
    "\u1100\u1161\u11a8", "Ab1", "株式会社", "full", "dza", "viiii",
]


@query(
    "tokenize_any_script",
    f"""SELECT note_id, array_to_string(list_concat(w, {FOLDED_WORDS!r}), ' ') AS words, len(w) + {len(FOLDED_WORDS)} AS n
        FROM words""",
)
def _(t):
    mixed = F.concat(F.coalesce("text", F.lit("")), F.lit(f" {FOLDED}"))
    words = t.texts.select("note_id", tx.tokenize_words(mixed).alias("w"))
    return words.select("note_id", F.array_join("w", " ").alias("words"), F.size("w").alias("n"))


@query("word_ngrams", "SELECT note_id, term, tf FROM doc_terms")
def _(t):
    terms = fx.document_terms(t.texts, key="note_id")
    return fx.unfolded_terms(terms, "note_id")


def _terms(t):
    """Terms of all notes, written down: the vocabulary and the weights both read them."""
    return cut_lineage(fx.document_terms(t.texts, key="note_id"), "terms")


@query("vocabulary", "SELECT term_idx, term, tf, df FROM vocab")
def _(t):
    return fx.vocabulary(fx.document_terms(t.texts, key="note_id"), MIN_DF, MAX_FEATURES)


@query(
    "tfidf",
    """SELECT note_id, term_idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY note_id)), 9) AS weight
       FROM weights""",
)
def _(t):
    terms = _terms(t)
    idf = fx.inverse_frequency(fx.vocabulary(terms, MIN_DF, MAX_FEATURES), terms.count())
    rows = fx.tfidf(terms, idf, key="note_id")
    long = fx.long_features(rows, key="note_id")
    return long.withColumn("weight", F.round("weight", 9))


def _vector_digest(vectors: pa.Array) -> pa.Array:
    """Width and non-zero places of sparse vectors, and their weights and places as one number."""
    lists, n = vectors.field("values"), len(vectors)
    rows = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    places, weights = (vectors.field(c).flatten().to_numpy(zero_copy_only=False) for c in ("indices", "values"))
    n_terms = np.bincount(rows[weights != 0], minlength=n).astype(np.int32)
    mixed = np.bincount(rows, weights * np.sin(places), n)
    return pa.StructArray.from_arrays([vectors.field("size"), pa.array(n_terms), pa.array(mixed)], ["width", "n_terms", "mixed"])


@query(
    "assemble_sparse_vectors",
    """SELECT note_id, (SELECT CAST(count(*) AS INT) FROM vocab) AS width,
       CAST(count(term_idx) AS INT) AS n_terms, round(coalesce(sum(w * sin(term_idx)) / sqrt(sum(w * w)), 0), 6) AS mixed
       FROM notes LEFT JOIN weights USING (note_id) GROUP BY note_id""",
)
def _(t):
    terms = _terms(t)
    idf = cut_lineage(
        fx.inverse_frequency(fx.vocabulary(terms, MIN_DF, MAX_FEATURES), terms.count()), "idf"
    )
    rows = fx.tfidf(terms, idf, key="note_id")
    vectors = fx.assemble_sparse_vectors(rows, idf.count(), key="note_id")
    read = F.arrow_udf(_vector_digest, "width int, n_terms int, mixed double")("features").alias("read")
    digests = vectors.select("note_id", F.inline(F.array(read)))
    return digests.withColumn("mixed", F.round("mixed", 6))


@query(
    "balanced_weights",
    """SELECT label_idx, count(*) AS n, CAST(sum(present) AS BIGINT) AS n_pos,
       count(*) / (2 * sum(present)) AS w_pos, count(*) / (2 * (count(*) - sum(present))) AS w_neg
       FROM cohort_matrix GROUP BY label_idx""",
)
def _(t):
    notes, labels = target(t)
    return md.balanced_weights(lb.label_vectors(notes, labels.cells, TOP_K), TOP_K)


class Trained:
    """A model of all labels over the training part of the cohort."""

    def __init__(self, t, k=TOP_K, params=ModelParams()):
        self.k = k
        keys = cut_lineage(silver(t), "silver")
        from cohortloom.operators.coverage import restrict_to_coded_cohort

        notes = cut_lineage(restrict_to_coded_cohort(keys, t.diagnoses), "cohort")
        target = lb.build_labels(notes.select("hadm_id"), t.diagnoses, k)
        self.labels, self.cells = target.labels, cut_lineage(target.cells, "cells")
        self.manifest = cut_lineage(sp.patient_split(notes.select("hadm_id", "subject_id")), "manifest")
        self.terms = cut_lineage(fx.document_terms(notes), "terms")
        train = sp.join_split_manifest(self.terms, self.manifest, "train")
        vocab = fx.vocabulary(train, FULL.min_df, FULL.max_features)
        self.idf = cut_lineage(fx.inverse_frequency(vocab, train.count()), "idf")
        self.size = self.idf.count()
        self.small = fx.term_dictionary(self.idf)
        vectors = lb.label_vectors(notes, self.cells, k)
        self.model = md.fit_ovr_logistic(
            fx.tfidf(train, self.small), vectors, self.labels, self.size, params
        )

    def scores(self, split=None):
        terms = self.terms
        if split is not None:
            terms = sp.join_split_manifest(terms, self.manifest, split)
        return md.predict_proba(fx.tfidf(terms, self.small), self.model, self.size)


@query("fit_ovr_logistic")
def _(t):
    model = Trained(t).model
    return model.select("label_idx", "icd_code", "intercept", F.size("coefficients").alias("n_terms"))


@query("predict_proba")
def _(t):
    return Trained(t).scores().select("hadm_id", F.inline("scores"))


@query("save_load_model")
def _(t):
    trained = Trained(t)
    stages = StagePaths(fresh_path(t.spark, "model"))
    md.save_model(trained.model, trained.idf, stages)
    model, idf = md.load_model(t.spark, stages)
    return model.select("icd_code", "intercept", F.size("coefficients").alias("n_terms"))


@query("train_and_evaluate")
def _(t):
    # thresholds from the validation part, metrics on the test part
    trained = Trained(t)
    val = sc.align_scores(trained.scores("val"), trained.cells)
    tuned = mx.tune_thresholds(sc.long_scores(val))
    test = cut_lineage(sc.align_scores(trained.scores("test"), trained.cells), "test")
    return mx.evaluate_multilabel(test, tuned, trained.k)


_STARTS = """SELECT note_id, w, n, unnest(range(0, CAST(greatest(ceil((n - 64) / 48.0), 0) AS BIGINT) + 1)) AS i
  FROM (SELECT note_id, string_split(c, ' ') AS w, len(string_split(c, ' ')) AS n FROM
    (SELECT note_id, trim(regexp_replace(text, '[\\s\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g')) AS c FROM notes)
    WHERE c <> '')"""
_CHUNKS = f"""SELECT note_id, CAST(i AS INT) AS chunk_idx, array_to_string(w[i * 48 + 1 : i * 48 + 64], ' ') AS tokens
  FROM ({_STARTS})"""


def _chunks(t):
    return ch.chunk_tokens(t.texts, window=64, stride=16, key="note_id")


@query("chunk_tokens", _CHUNKS)
def _(t):
    return _chunks(t).select("note_id", "chunk_idx", F.array_join("tokens", " ").alias("tokens"))


@query(
    "chunk_labels",
    f"""SELECT note_id, chunk_idx, bits FROM ({_CHUNKS}) JOIN (SELECT note_id,
       string_agg(CAST(present AS VARCHAR), '' ORDER BY label_idx) AS bits
       FROM cohort_matrix JOIN cohort USING (hadm_id) GROUP BY note_id) USING (note_id)""",
)
def _(t):
    notes, labels = target(t)
    ids = silver(t).select("note_id", "hadm_id")
    vectors = lb.label_vectors(notes, labels.cells, TOP_K).join(ids, "hadm_id")
    joined = ch.chunk_labels(_chunks(t), vectors.select("note_id", "y"), key="note_id")
    bits = F.array_join(F.col("y").cast("array<string>"), "")
    return joined.select("note_id", "chunk_idx", bits.alias("bits"))


# a probability per chunk and label, made of the place of the chunk and the code
_CHUNK_PROB = "CAST((chunk_idx * 31 + {n} * 7 + length(note_id) * 13) % 89 AS DOUBLE) / 89.0"


@query(
    "maxpool_chunks",
    f"""SELECT note_id, icd_code, coalesce(max({_CHUNK_PROB.format(n="label_idx")}), 0) AS prob
       FROM notes CROSS JOIN label_names LEFT JOIN ({_CHUNKS}) c USING (note_id) GROUP BY 1, 2""",
)
def _(t):
    from cohortloom.sources.views import LABELS

    names = t.spark.createDataFrame(list(enumerate(LABELS)), "label_idx int, icd_code string")
    cells = F.inline(F.array(*[
        F.struct(
            F.lit(code).alias("icd_code"),
            F.expr(f"CAST({_CHUNK_PROB.format(n=i)} AS DOUBLE)").alias("prob"),
        )
        for i, code in enumerate(LABELS)
    ]))
    scored = _chunks(t).select("note_id", cells)
    return ch.maxpool_chunks(scored, t.notes, names, key="note_id")


@query(
    "chunk_stats",
    f"""SELECT (SELECT count(*) FROM notes) AS n_docs, count(*) AS n_chunks,
       count(*) / (SELECT count(*) FROM notes) AS avg_chunks_per_doc FROM ({_CHUNKS})""",
)
def _(t):
    return ch.chunk_stats(_chunks(t), t.notes.agg(F.count(F.lit(1))))


@query(
    "stream_score_documents",
    """SELECT hadm_id, string_agg(icd_code, ',' ORDER BY prob DESC, icd_code) AS codes,
       coalesce(string_agg(icd_code, ',' ORDER BY prob DESC, icd_code) FILTER (pred = 1), '') AS thresholded
       FROM decided GROUP BY hadm_id""",
)
def _(t):
    # the scores of arriving documents, by the expression the batch view uses
    thresholds = sc.threshold_map(t.cutoffs)
    documents = jobs.read_table(t.spark, f"{t.sf_dir}/documents.parquet", t.base("documents").schema)
    arriving = t.scores_of(documents)
    scored = jobs.drain(jobs.stream_score_documents(arriving, thresholds), "score-stream")
    return scored.select(
        "hadm_id",
        F.array_join("codes", ",").alias("codes"),
        F.array_join("thresholded", ",").alias("thresholded"),
    )


@query("stream_score_notes")
def _(t):
    # raw notes as a stream, through cleaning, features and a fitted model to thresholded codes
    trained = Trained(t)
    val = sc.align_scores(trained.scores("val"), trained.cells)
    thresholds = sc.threshold_map(mx.tune_thresholds(sc.long_scores(val)))
    root = fresh_path(t.spark, "notes-stream")
    documents = jobs.read_table(t.spark, f"{t.sf_dir}/documents.parquet", t.base("documents").schema)
    notes = documents.select(F.col("doc_id").alias("hadm_id"), "text")
    body = jobs.scoring_batch(trained.small, trained.model, trained.size, thresholds, f"{root}/out")
    jobs.stream_score_notes(notes, body, f"{root}/state")
    return t.spark.read.parquet(f"{root}/out").select(
        "hadm_id", F.array_join("codes", ",").alias("codes"), F.size("thresholded").alias("n_on")
    )
