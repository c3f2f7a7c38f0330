"""Operators for building training corpora: sharding, URL filtering, subword encoding,
near-duplicate joins, mixing, quality rules, WARC files, fingerprints, language models, exact search,
audits of filters and resampling toward a target.

Nothing outside this package imports it. ``hardwood.llm.queries`` lists the registered queries.
"""
