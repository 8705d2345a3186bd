"""All queries and SQL of the subpackage."""

from lorewright.llm import p1_names, p2_split, p3_boilerplate, p4_lookalikes, p5_sentences, p6_tokens, p7_leaks, p8_mojibake

QUERIES, SQL = {}, {}
for _module in (p1_names, p2_split, p3_boilerplate, p4_lookalikes, p5_sentences, p6_tokens, p7_leaks, p8_mojibake):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
