"""Training-data operators (text cleaning, dedup, scoring, packing).

Nothing outside this folder imports it. The registered queries are in
``rollcall.llm.queries``, their SQL in ``rollcall.llm.oracle``.
"""
