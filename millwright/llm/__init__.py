"""Training-data pipeline operators (those of README "Corpus operators").

One module per operator; ``queries`` registers the thin ``opN_<name>`` queries.
Nothing outside this folder imports it except ``__spark_entry__`` and ``corpus_pipeline``.
"""
