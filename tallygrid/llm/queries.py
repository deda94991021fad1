"""The registered queries of the corpus operators, and their SQL where there is any."""

from __future__ import annotations

from tallygrid.llm.bitplanes import op1_bit_plane_ids
from tallygrid.llm.divergence import OP12_SQL, op12_source_divergence
from tallygrid.llm.exact import OP11_SQL, op11_exact_groups
from tallygrid.llm.imatch import op3_imatch_fingerprints
from tallygrid.llm.importance import OP13_SQL, op13_importance_draw
from tallygrid.llm.lines import OP9_SQL, op9_line_dedup
from tallygrid.llm.mixing import OP4_SQL, op4_fair_queue_mix
from tallygrid.llm.packing import op2_mixture_packing
from tallygrid.llm.sharding import op10_lookup_shards
from tallygrid.llm.simhash import op5_simhash_components
from tallygrid.llm.topk import OP8_SQL, op8_maxscore_topk
from tallygrid.llm.toxicity import op7_restored_toxicity
from tallygrid.llm.urlfilter import OP6_SQL, op6_cascade_verdicts

QUERIES = {
    f.__name__: f
    for f in (
        op1_bit_plane_ids, op2_mixture_packing, op3_imatch_fingerprints, op4_fair_queue_mix, op5_simhash_components,
        op6_cascade_verdicts, op7_restored_toxicity, op8_maxscore_topk, op9_line_dedup, op10_lookup_shards,
        op11_exact_groups, op12_source_divergence, op13_importance_draw,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op4_fair_queue_mix": OP4_SQL, "op6_cascade_verdicts": OP6_SQL, "op8_maxscore_topk": OP8_SQL, "op9_line_dedup": OP9_SQL,
    "op11_exact_groups": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_importance_draw": OP13_SQL,
}
