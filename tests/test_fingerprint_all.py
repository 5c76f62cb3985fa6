import hashlib
import unicodedata

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_fingerprints_of_all_documents(spark):
    def plain(t):
        return None if t is None else hashlib.sha256(" ".join(unicodedata.normalize("NFKC", t).casefold().split()).encode()).hexdigest()

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.fingerprint for r in __spark_entry__.queries()["content_fingerprint_all"](spark, SF).collect()}
    assert got == {r.doc_id: plain(r.text) for r in docs}
    assert any(r.text is None for r in docs) and any(r.text and not r.text.isascii() for r in docs)
