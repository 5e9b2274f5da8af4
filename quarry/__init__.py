"""quarry: find passages that meet a criterion in large text collections, on Spark.

Documents (HTML, plain text, extracted page text) become numbered passages;
passages go through a cascade of user-supplied judges; findings, verdict
trails and run totals are tables that can be resumed or fed by a stream.
"""

__version__ = "0.1.0"
