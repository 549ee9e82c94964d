"""Item classifier (M6): multinomial naive Bayes on term counts over group folds, as sparse tables.

A model is trained on all folds but one, for each fold, and their log-probabilities are added, which is the arg-max of
their geometric mean. All of it is sums of counts: the counts of each (term, label) and (label) by fold are aggregated
once, combined map-side, and the counts of a fold's training rows are the total less its own. A label's score of a text is

    prior(label) - length * mass(label) + sum over the text's terms of count * weight(term, label)

where weight is zero for a term that the label never had, so only (term, label) pairs that occur are stored, and texts in long
form meet them block by block. No row ever holds an array of classes; items may be any number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matforge.operators.models import N_FOLDS
from matforge.operators.text import tokens
from matforge.session import written


@dataclass
class TermClassifier:
    """weights: (term, label, weight); labels: (label, prior, mass, rows); terms: (term) of the training texts."""

    weights: DataFrame
    labels: DataFrame
    terms: DataFrame


def fit_term_classifier(rows: DataFrame, label: str, text: str, fold: Column, n_folds: int = N_FOLDS, alpha: float = 1.0) -> TermClassifier:
    """Sufficient statistics of ``n_folds`` models; ``fold`` is an integer from 0 that a row's model does not see.

    Rows without a label are left out; a null text has no terms. A label or term that a fold's model has not seen keeps its
    smoothed probability, so every model knows all labels and terms.
    """
    own = rows.select(F.col(label).alias("label"), F.coalesce(F.col(text), F.lit("")).alias("text"), fold.alias("fold")).where(F.col("label").isNotNull())
    # Equal texts of a label and fold are tokenised once.
    own = written(own.groupBy("label", "fold", "text").agg(F.count(F.lit(1)).alias("n")), "classifier-texts")
    counts = own.select("label", "fold", "n", F.explode(tokens(F.col("text"))).alias("term")).groupBy("label", "fold", "term").agg(F.sum("n").alias("c"))
    counts = written(counts, "classifier-counts")
    terms = counts.select("term").distinct()
    of = lambda c, f: F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0))
    rest = lambda c, f: F.sum(c) - of(c, f)
    weight = sum(((F.log((rest("c", f) + alpha) / alpha)) for f in range(1, n_folds)), F.log((rest("c", 0) + alpha) / alpha))
    weights = counts.groupBy("term", "label").agg(weight.alias("weight"))
    whole = own.agg(F.countDistinct("label").alias("_labels"), *(rest("n", f).alias(f"_rows{f}") for f in range(n_folds)))
    size = terms.agg(F.count(F.lit(1)).alias("_terms"))
    mass = counts.groupBy("label").agg(*(rest("c", f).alias(f"_mass{f}") for f in range(n_folds)))
    mine = own.groupBy("label").agg(F.sum("n").alias("rows"), *(rest("n", f).alias(f"_own{f}") for f in range(n_folds)))
    one = whole.crossJoin(size)  # one row
    joined = mine.join(mass, "label", "left").crossJoin(F.broadcast(one))
    prior = sum((F.log((F.col(f"_own{f}") + 1) / (F.col(f"_rows{f}") + F.col("_labels"))) for f in range(1, n_folds)),
                F.log((F.col("_own0") + 1) / (F.col("_rows0") + F.col("_labels"))))
    held = lambda f: F.log(F.coalesce(f"_mass{f}", F.lit(0)) + alpha * F.greatest("_terms", F.lit(1)))
    labels = joined.select("label", prior.alias("prior"), sum((held(f) for f in range(1, n_folds)), held(0)).alias("mass"), "rows")
    return TermClassifier(written(weights, "classifier-weights"), written(labels, "classifier-labels"), written(terms, "classifier-terms"))


#: Rows of a block of weights or of terms of texts; a task holds one of each.
BLOCK_ROWS = 50_000


def classify_texts(model: TermClassifier, texts: DataFrame, text: str, digits: int = 6) -> DataFrame:
    """(text, label, score) for every distinct text: the best label among those that share a term with it.

    Scores are rounded to ``digits`` before they are compared, and ties go to the smallest label, so that the order of additions
    decides nothing. A text without a known term gets the label of the greatest prior and a null score; without labels the
    label is null. Texts of the same terms are scored once. Every block of texts meets every block of labels, and of a pair of blocks only the best
    label of each text goes on: the pairs of texts and labels with a common term are many times the rows, and none is moved.
    """
    own = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    own = written(own.select("text", F.concat_ws(" ", F.sort_array(tokens(F.col("text")))).alias("bag")), "distinct-texts")
    tf = own.select("bag").distinct().select("bag", F.explode(F.filter(F.split("bag", " "), lambda t: t != "")).alias("term"))
    tf = tf.groupBy("bag", "term").agg(F.count(F.lit(1)).alias("tf"))
    # Spark sizes an explode like the file below it, and both sides grow with the data: merged, never broadcast.
    known = written(tf.hint("merge").join(model.terms, "term").select("bag", "term", F.col("tf").cast("double").alias("tf"),
                                                              F.sum("tf").over(Window.partitionBy("bag")).cast("double").alias("length")), "known-terms")
    weights = model.weights.hint("merge").join(model.labels.select("label", "prior", "mass"), "label")
    n_texts, n_labels = (max(1, -(-t.count() // BLOCK_ROWS)) for t in (known, model.weights))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = known.select(block("bag", n_texts).alias("tb"), every(n_labels).alias("lb"), "bag", "term", "tf", "length")
    right = weights.select(block("label", n_labels).alias("lb"), every(n_texts).alias("tb"), "label", "term", "weight", "prior", "mass")
    kind = T.StructType([T.StructField("bag", T.StringType()), T.StructField("worse", T.DoubleType()), model.labels.schema["label"]])
    scored = left.groupBy("tb", "lb").cogroup(right.groupBy("tb", "lb")).applyInArrow(_best_labels(digits, kind), kind)
    best = scored.groupBy("bag").agg(F.min(F.struct("worse", "label")).alias("best"))
    common = model.labels.agg(F.min(F.struct((-F.round("prior", digits)).alias("worse"), "label")).alias("common"))  # one row
    out = own.join(best, "bag", "left").crossJoin(F.broadcast(common))
    return out.select("text", F.coalesce("best.label", "common.label").alias("label"), (-F.col("best.worse")).alias("score"))


def _best_labels(digits: int, kind: T.StructType):
    """(bag, worse, label) for each text of a block that shares a term with a label of the other block: its best label there."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def runs(codes):
        """Places of each code, by code."""
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(np.bincount(codes, minlength=int(codes.max()) + 1 if len(codes) else 0))
        return order, np.concatenate([[0], ends])

    def best(texts: pa.Table, weights: pa.Table) -> pa.Table:
        bags, worse, found = [], [], []
        if texts.num_rows and weights.num_rows:
            weights = weights.sort_by("label").combine_chunks()  # of equal scores the first, so the smallest label
            label = weights["label"].combine_chunks().dictionary_encode()
            at, names = label.indices.to_numpy(), label.dictionary
            prior, mass, total = (np.zeros(len(names)) for _ in range(3))
            prior[at], mass[at] = weights["prior"].to_numpy(), weights["mass"].to_numpy()
            terms = pc.unique(weights["term"])
            order, ends = runs(pc.index_in(weights["term"].combine_chunks(), terms).to_numpy())
            at, weight = at[order], weights["weight"].to_numpy()[order]
            bag = texts["bag"].combine_chunks().dictionary_encode()
            rows, stops = runs(bag.indices.to_numpy())
            code = pc.fill_null(pc.index_in(texts["term"].combine_chunks(), terms), -1).to_numpy()[rows]
            tf = texts["tf"].to_numpy()[rows]
            length = texts["length"].to_numpy()[rows]
            for k in range(len(stops) - 1):
                mine = [(at[ends[c]:ends[c + 1]], f, weight[ends[c]:ends[c + 1]]) for c, f in zip(code[stops[k]:stops[k + 1]], tf[stops[k]:stops[k + 1]]) if c >= 0]
                if not mine:
                    continue
                for labels, f, w in mine:  # a label has a term once
                    total[labels] += f * w
                seen = np.concatenate([m[0] for m in mine])
                score = prior[seen] - length[stops[k]] * mass[seen] + total[seen]
                total[seen] = 0.0
                score = np.sign(score) * np.floor(np.abs(score) * 10.0 ** digits + 0.5) / 10.0 ** digits
                top = score.max()
                bags.append(k)
                worse.append(-top)
                found.append(seen[score == top].min())
            return pa.Table.from_arrays([bag.dictionary.take(pa.array(bags, pa.int64())), pa.array(worse, pa.float64()), names.take(pa.array(found, pa.int64()))], names=kind.names)
        return pa.Table.from_arrays([pa.array([], pa.string()), pa.array([], pa.float64()), weights["label"].slice(0, 0)], names=kind.names)

    return best
