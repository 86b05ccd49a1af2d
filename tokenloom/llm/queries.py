"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import divergence, licenses, quality, trie
from tokenloom.llm.bpe import op10_bpe
from tokenloom.llm.divergence import op13_divergence
from tokenloom.llm.embeddings import op5_embeddings
from tokenloom.llm.licenses import op4_licenses
from tokenloom.llm.linechunks import op9_line_chunks
from tokenloom.llm.packing import op3_packing
from tokenloom.llm.pii import op1_pii
from tokenloom.llm.quality import op11_quality
from tokenloom.llm.repair import op7_repair
from tokenloom.llm.simhash import op2_simhash
from tokenloom.llm.sketches import op8_sketch
from tokenloom.llm.toxicity import op6_toxicity
from tokenloom.llm.trie import op12_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_licenses": op4_licenses,
    "op5_embeddings": op5_embeddings,
    "op6_toxicity": op6_toxicity,
    "op7_repair": op7_repair,
    "op8_sketch": op8_sketch,
    "op9_line_chunks": op9_line_chunks,
    "op10_bpe": op10_bpe,
    "op11_quality": op11_quality,
    "op12_trie": op12_trie,
    "op13_divergence": op13_divergence,
}

#: The others can't be had in SQL, or not over whole tables in reasonable time; tests hold them to brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_licenses": licenses.oracle(),
    "op5_embeddings": """with recursive v as (
  select row_number() over () as r, vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.r as x, b.r as y, b.vec_id as to_id from v a join v b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select x, y, to_id from links union select reach.x, links.y, links.to_id from reach join links on links.x = reach.y),
found as (select v.vec_id, (select count(*) from links where x = v.r) as n, least(v.vec_id, (select min(to_id) from reach where x = v.r)) as c from v)
select vec_id, n as n_links, c as component_id, vec_id = c as kept from found
union all select vec_id, 0, vec_id, true from embeddings e where not exists (from v where v.vec_id = e.vec_id)""",
    "op11_quality": quality.oracle(),
    "op12_trie": trie.oracle(),
    "op13_divergence": divergence.oracle(),
}
