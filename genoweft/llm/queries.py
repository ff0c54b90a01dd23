"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from . import collocations, license_scan
from .collocations import op11_suffix_automata
from .context_mixing import op10_context_mixing
from .conversation_repair import op12_lazy_determinisation
from .html_text import op7_html_text
from .language_net import op5_byte_cnn
from .license_scan import op13_license_scan
from .ngram_join import op4_ngram_jaccard_join
from .piece_codec import op1_sentencepiece
from .projection_forest import op6_projection_forest
from .simhash import op2_simhash
from .source_mix import op3_pareto_mix
from .token_counts import op8_token_counts
from .toxicity import op9_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_simhash, op3_pareto_mix, op4_ngram_jaccard_join, op5_byte_cnn,
        op6_projection_forest, op7_html_text, op8_token_counts, op9_toxicity, op10_context_mixing, op11_suffix_automata,
        op12_lazy_determinisation, op13_license_scan,
    )
}
ORACLES: dict[str, str] = {"op11_suffix_automata": collocations.SQL, "op13_license_scan": license_scan.SQL}
