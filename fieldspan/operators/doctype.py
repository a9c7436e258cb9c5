"""Document types by a linear model over word n-grams: an approximation of a calibrated linear SVM (the
library has neither character n-grams inside words nor that calibration, so no parity is claimed)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, NGram, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame


def fit(docs: DataFrame, text: str = "text", label: str = "doc_type", min_df: float = 2.0, vocabulary: int = 60_000):
    """Pipeline model: words and word pairs, inverse document frequency, unit length, multinomial regression."""
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(docs)
    stages = [index, RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\w\w+", gaps=False), NGram(n=2, inputCol="_w", outputCol="_n"),
              CountVectorizer(inputCol="_w", outputCol="_wc", minDF=min_df, vocabSize=vocabulary), CountVectorizer(inputCol="_n", outputCol="_nc", minDF=min_df, vocabSize=vocabulary),
              IDF(inputCol="_wc", outputCol="_wi"), IDF(inputCol="_nc", outputCol="_ni"), VectorAssembler(inputCols=["_wi", "_ni"], outputCol="_a"),
              Normalizer(inputCol="_a", outputCol="_f"), LogisticRegression(featuresCol="_f", labelCol="_y", predictionCol="_p", maxIter=50, regParam=1e-3, family="multinomial"),
              IndexToString(inputCol="_p", outputCol="predicted_type", labels=index.labels)]
    return Pipeline(stages=stages).fit(docs)


def predict(model, docs: DataFrame) -> DataFrame:
    from pyspark.ml import PipelineModel

    # the label is not needed for prediction
    out = PipelineModel(model.stages[1:]).transform(docs)
    return out.select(*docs.columns, "predicted_type")
