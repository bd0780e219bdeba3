"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from larkspar.llm.op01_exact_dedup import OP1_SQL, op1_exact_dedup
from larkspar.llm.op02_suffix_array import op2_suffix_array
from larkspar.llm.op03_toxicity import op3_toxicity
from larkspar.llm.op04_phrases import op4_phrases
from larkspar.llm.op05_quality import op5_quality
from larkspar.llm.op06_jaccard import op6_jaccard
from larkspar.llm.op07_sentencepiece import op7_sentencepiece
from larkspar.llm.op08_topk import OP8_SQL, op8_topk
from larkspar.llm.op09_mixing import op9_mixing
from larkspar.llm.op10_language import op10_language
from larkspar.llm.op11_middle import OP11_SQL, op11_middle
from larkspar.llm.op12_personal import op12_personal
from larkspar.llm.op13_whitening import op13_whitening
from larkspar.llm.oracle import OP2_SQL, OP4_SQL, OP6_SQL

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_suffix_array": op2_suffix_array,
    "op3_toxicity": op3_toxicity,
    "op4_phrases": op4_phrases,
    "op5_quality": op5_quality,
    "op6_jaccard": op6_jaccard,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_topk": op8_topk,
    "op9_mixing": op9_mixing,
    "op10_language": op10_language,
    "op11_middle": op11_middle,
    "op12_personal": op12_personal,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op2_suffix_array": OP2_SQL,
    "op4_phrases": OP4_SQL,
    "op6_jaccard": OP6_SQL,
    "op8_topk": OP8_SQL,
    "op11_middle": OP11_SQL,
}
