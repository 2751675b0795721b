"""The pipeline's stages on the smallest tables, each held against a plain version on its own input."""

import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from loomtext.llm.shared import SPACES, stash, table

from .test_similar import pairs_of

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = stash(stage(spark, docs, SMALL), f"test-{name}")
        seen[name] = before, docs
        if name != "encoding":
            assert docs.columns == columns
            assert set(r.doc_id for r in docs.select("doc_id").collect()) <= set(before)
    before, after = seen["exact"]
    best = {}
    for i, t in before.items():
        key = t.translate(dict.fromkeys(map(ord, SPACES)))
        best[key] = min(best.get(key, (1, 0)), (-len(t), i))
    assert sorted(i for _, i in best.values()) == sorted(r.doc_id for r in after.collect())
    before, after = seen["near"]
    rows, left = sorted(before.items()), {r.doc_id for r in after.collect()}
    assert not [p for p in pairs_of(rows, 0.84) if rows[p[0]][0] in left and rows[p[1]][0] in left]
    assert set(before) - left <= {rows[i][0] for i, _ in pairs_of(rows, 0.74)}
    before, after = seen["mixing"]
    assert 0 < after.count() < len(before)
    before, after = seen["encoding"]
    import base64

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in after.collect():
        ids = library.encode_ordinary(before[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()
