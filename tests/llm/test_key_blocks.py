"""The secrets stage takes private keys out whole."""

import base64
import random

import corpus_pipeline

BODY = base64.b64encode(random.Random(5).randbytes(700)).decode()
LINES = [BODY[i : i + 64] for i in range(0, len(BODY), 64)]
BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
CASES = {
    "é before\n" + "\n".join([BEGIN, *LINES, END]) + "\nafter it": "é before\n[SECRET]\nafter it",
    "\r\n".join(["a", BEGIN, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,AB12", "", *LINES, END, "b"]): "a\r\n[SECRET]\r\nb",
    "x = '" + "\\n".join([BEGIN, *LINES, END]) + "' # y": "x = '[SECRET]' # y",
    "\n".join(["a", BEGIN, *LINES, "", "Some words follow the key.", "End."]): "a\n[SECRET]\n\nSome words follow the key.\nEnd.",
    "\n".join(["a", BEGIN, "Proc-Type: 4,ENCRYPTED", "", *LINES]): "a\n[SECRET]",
    "\n".join([BEGIN, *LINES, "then", BEGIN, *LINES, END, "z"]): None,
    f"The line {BEGIN} starts a key.": "The line [SECRET] starts a key.",
    f"{BEGIN}\n" + "A" * 200_000: "[SECRET]",
    "\n".join([BEGIN] + LINES * 400 + [END, "z"]): "[SECRET]\nz",
    "no key": "no key",
}


def test_private_keys_go_whole(spark):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id bigint, text string").selectExpr("doc_id", "text", "bigint(length(text)) n_chars")
    got = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, docs, "").collect()}
    for n, (text, want) in enumerate(CASES.items()):
        if want is None:
            assert not any(line in got[n] for line in LINES[:-1]) and got[n].endswith("[SECRET]\nz")
        else:
            assert got[n] == want, (n, got[n][:300])
