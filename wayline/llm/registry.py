"""The numbered operators' queries and their DuckDB oracles."""

from __future__ import annotations

from wayline.llm.langid import op8_langid
from wayline.llm import collocations, licenses, minhash, sharding
from wayline.llm.collocations import op13_collocations
from wayline.llm.licenses import op1_licenses
from wayline.llm.media import op6_media
from wayline.llm.minhash import op12_minhash
from wayline.llm.mixing import op3_mixing
from wayline.llm.neighbours import op2_neighbours
from wayline.llm.packing import op9_packing
from wayline.llm.quality import op4_quality
from wayline.llm.sharding import op7_sharding
from wayline.llm.simhash import op10_simhash
from wayline.llm.toxicity import op5_toxicity
from wayline.llm.whitening import op11_whitening

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_neighbours": op2_neighbours,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_media": op6_media,
    "op7_sharding": op7_sharding,
    "op8_langid": op8_langid,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_minhash": op12_minhash,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {"op1_licenses": licenses.ORACLE, "op7_sharding": sharding.ORACLE, "op12_minhash": minhash.ORACLE, "op13_collocations": collocations.ORACLE}
