"""Recall of the candidate searches on whole tables: queries are the rows whose id is divisible by 50, against all rows.

    python -m tests.llm.recall /root/testdata/check_s

Near-duplicates: links are pairs with a Jaccard likeness of five-word shingles of 0.8 or more, found by an inverted
index; each is tested for the radius and the tables of the pipeline's stage. Vectors: links by all cosines.
"""

import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow.dataset as ds

from tokenloom.llm import embeddings, simhash


def near_duplicates(path: str) -> dict:
    """By band of likeness: links between unlike sets, those within the radius, and those that a table finds too."""
    table = ds.dataset(f"{path}/documents.parquet").to_table(columns=["doc_id", "text"])
    ids = table.column("doc_id").to_numpy()
    sets = [simhash._set(t.as_py() or "") for t in table.column("text")]
    owners: dict[int, list[int]] = defaultdict(list)
    asked = [k for k in range(len(ids)) if ids[k] % 50 == 0 and len(sets[k])]
    wanted = {int(h) for k in asked for h in sets[k]}
    for k, s in enumerate(sets):
        for h in s.tolist():
            if h in wanted:
                owners[h].append(k)
    prints: dict[int, np.ndarray] = {}

    def fingerprint(k: int) -> np.ndarray:
        if k not in prints:
            prints[k] = np.frombuffer(simhash.wide_fingerprint(table.column("text")[k].as_py()), np.uint64).reshape(1, 4)
        return prints[k]

    radius, found = simhash.wide_radius(simhash.SIMILARITY), Counter()
    for k in asked:
        shared = Counter(j for h in sets[k].tolist() for j in owners[h])
        for j, n in shared.items():
            union = len(sets[k]) + len(sets[j]) - n
            if j != k and 5 * n >= 4 * union and n < union:
                band = min(int(20 * n / union), 19) / 20
                near = int(np.bitwise_count(fingerprint(k) ^ fingerprint(j)).sum()) <= radius
                found[band, "links"] += 1
                found[band, "radius"] += near
                found[band, "found"] += near and bool((simhash.wide_buckets(fingerprint(k)) == simhash.wide_buckets(fingerprint(j))).any())
    return {band: tuple(found[band, c] for c in ("links", "radius", "found")) for band in sorted({b for b, _ in found})}


def vectors(path: str, spark) -> tuple[int, int]:
    """Links of the queries by all cosines, and as the operator counts them."""
    table = ds.dataset(f"{path}/embeddings.parquet").to_table(columns=["vec_id", "embedding", "label"]).to_pandas()
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(spark.read.parquet(f"{path}/embeddings.parquet")).collect()}
    sound = table[table.label.notna() & table.embedding.map(lambda v: v is not None and len(v) > 0 and bool(np.isfinite(np.array(v, float)).all()) and bool(np.any(np.array(v, float))))]
    want = have = 0
    for _, group in sound.groupby("label"):
        x = np.array([np.array(v, np.float64) for v in group.embedding])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for k, vec_id in enumerate(group.vec_id):
            if vec_id % 50 == 0:
                want += int((x @ x[k] >= embeddings.COSINE).sum()) - 1
                have += got[vec_id]
    return want, have


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    path = sys.argv[1]
    for band, counts in near_duplicates(path).items():
        print(f"likeness {band:.2f}: links {counts[0]}, in the radius {counts[1]}, found {counts[2]}")
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    print("vector links: {} by all cosines, {} found".format(*vectors(path, session)))
