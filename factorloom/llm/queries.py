"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .archives import OP10_SQL, op10_warc
from .contamination import OP4_SQL, op4_decontamination
from .html import op8_html_text
from .language import op5_language_id
from .neighbours import op9_permutation_ann
from .packing import op2_best_fit_packing
from .quality import op3_quality
from .secrets import COUNTS_SQL, op6_secret_scan, secret_base_counts
from .simhash import op1_simhash_dedup
from .tokens import op7_token_files


def queries():
    made = [op1_simhash_dedup, op2_best_fit_packing, op3_quality, op4_decontamination, op5_language_id, op6_secret_scan, op7_token_files, op8_html_text, op9_permutation_ann, op10_warc, secret_base_counts]
    return {f.__name__: f for f in made}


def oracle_sql():
    return {"op4_decontamination": OP4_SQL, "op10_warc": OP10_SQL, "secret_base_counts": COUNTS_SQL}
