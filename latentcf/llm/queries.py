"""Registered queries of the subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from latentcf.llm import oracles
from latentcf.llm.decontaminate import op6_decontaminate
from latentcf.llm.fill_middle import op13_fill_middle
from latentcf.llm.html_text import op5_html_text
from latentcf.llm.mixing import op12_mixing
from latentcf.llm.multiset import op2_multiset
from latentcf.llm.packing import op10_packing
from latentcf.llm.pii import op1_pii
from latentcf.llm.secrets import op9_secrets
from latentcf.llm.simhash import op3_simhash
from latentcf.llm.toxicity import op7_toxicity
from latentcf.llm.training_order import op4_training_order
from latentcf.llm.warc import op8_warc
from latentcf.llm.whitening import op11_whitening

QUERIES = {
    "op1_pii": op1_pii,
    "op2_multiset": op2_multiset,
    "op3_simhash": op3_simhash,
    "op4_training_order": op4_training_order,
    "op5_html_text": op5_html_text,
    "op6_decontaminate": op6_decontaminate,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_secrets": op9_secrets,
    "op10_packing": op10_packing,
    "op11_whitening": op11_whitening,
    "op12_mixing": op12_mixing,
    "op13_fill_middle": op13_fill_middle,
}
#: SQL where it can express the operator; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op5_html_text": oracles.OP5,
    "op8_warc": oracles.OP8,
    "op9_secrets": oracles.OP9,
    "op12_mixing": oracles.OP12,
    "op13_fill_middle": oracles.OP13,
}
