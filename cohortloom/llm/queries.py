"""Registered queries of this subpackage over the given tables."""

from __future__ import annotations

from cohortloom.llm import (
    archives,
    bitplanes,
    decontaminate,
    hnsw,
    infill,
    jaccard,
    licenses,
    packing,
    pii,
    quality,
    repeats,
    spelling,
    trie_lm,
)
from cohortloom.llm.common import table

QUERIES = {
    "op1_decontaminate": lambda s, d: decontaminate.contamination(
        table(s, d, "documents"), table(s, d, "benchmark")
    ),
    "op2_hnsw": lambda s, d: hnsw.nearest(table(s, d, "embeddings")),
    "op3_pack": lambda s, d: packing.pieces(table(s, d, "documents")).drop("ids"),
    "op4_token_planes": lambda s, d: bitplanes.round_trip(table(s, d, "documents")),
    "op5_licenses": lambda s, d: licenses.notices(table(s, d, "documents")),
    "op6_repeats": lambda s, d: repeats.without_repeats(table(s, d, "documents")),
    "op7_jaccard": lambda s, d: jaccard.linked(table(s, d, "documents"), size=3, percent=90),
    "op8_trie_lm": lambda s, d: trie_lm.scores(table(s, d, "documents")),
    "op9_personal_data": lambda s, d: pii.scan(table(s, d, "documents")),
    "op10_quality": lambda s, d: quality.ratings(table(s, d, "documents"), table(s, d, "labels")),
    "op11_zip_warc": lambda s, d: archives.round_trip(table(s, d, "pages")),
    "op12_infill": lambda s, d: infill.digests(table(s, d, "documents")),
    "op13_spelling": lambda s, d: spelling.variants(table(s, d, "documents")),
}
ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.SQL,
    "op11_zip_warc": archives.SQL,
    "op12_infill": infill.SQL,
}
