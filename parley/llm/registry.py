"""The queries of this subpackage and their SQL."""

from . import bpe, chat, embeddings, fingerprints, language, licenses, lines, mixing, ngram_join, periods, pii, spelling, substrings

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_pii": pii.op2_pii,
    "op3_language": language.op3_language,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_chat": chat.op5_chat,
    "op6_bpe": bpe.op6_bpe,
    "op7_substrings": substrings.op7_substrings,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_embeddings": embeddings.op10_embeddings,
    "op11_spelling": spelling.op11_spelling,
    "op12_periods": periods.op12_periods,
    "op13_licenses": licenses.op13_licenses,
}
ORACLES = {"op8_ngram_join": ngram_join.SQL, "op10_embeddings": embeddings.SQL, "op13_licenses": licenses.SQL}
