"""Operations of a large-scale training-data pipeline, written for Spark.

Nothing else in the library imports this subpackage.  Every operator is a
function over DataFrames; the thin ``opN_*`` queries live in
:mod:`kbspark.llm.queries`.
"""
