"""All driver queries of this subpackage, and the SQL of those that SQL can express."""

from . import divergence, interaction, langid, lines, packing, pieces, quality, rules, sharding, simhash, topk, toxicity, vectors

MODULES = (langid, simhash, toxicity, pieces, quality, packing, sharding, topk, vectors, lines, interaction, divergence, rules)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in getattr(m, "SQL", {}).items()}
