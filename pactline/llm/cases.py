"""Registered queries of this subpackage, each with the SQL it must equal, or None."""

from __future__ import annotations

from pactline.llm import (
    chaining, decontaminate, host_rules, jaccard_join, mixing, periods, preference, revisits, secrets, simhash, spelling, suffix_dedup, toxicity,
)

CASES = {
    "op1_suffix_dedup": (suffix_dedup.op1_suffix_dedup, None),
    "op2_jaccard_join": (jaccard_join.op2_jaccard_join, jaccard_join.OP2_SQL),
    "op3_toxicity": (toxicity.op3_toxicity, None),
    "op4_preference_pairs": (preference.op4_preference_pairs, preference.OP4_SQL),
    "op5_mix_sources": (mixing.op5_mix, mixing.OP5_SQL),
    "op6_host_rules": (host_rules.op6_host_rules, host_rules.OP6_SQL),
    "op7_revisits": (revisits.op7_revisits, revisits.OP7_SQL),
    "op8_decontaminate": (decontaminate.op8_decontaminate, None),
    "op9_secret_scan": (secrets.op9_secret_scan, None),
    "op10_fuzzy_passages": (chaining.op10_fuzzy_passages, None),
    "op11_periodic_runs": (periods.op11_periodic_runs, None),
    "op12_simhash_components": (simhash.op12_simhash_components, None),
    "op13_spelling_groups": (spelling.op13_spelling_groups, None),
}
