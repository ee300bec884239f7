import re
from re import _parser

import brute
from newslake.llm import licenses


def strings(parsed):
    """Strings that a parsed pattern matches: each branch and repeat count up to one, one letter or digit per class."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            own = [chr(arg)]
        elif name == "IN":
            own = [chr(x[1][0] if isinstance(x[1], tuple) else x[1]) for x in arg]
        elif name == "BRANCH":
            own = [s for branch in arg[1] for s in strings(branch)]
        elif name == "SUBPATTERN":
            own = strings(arg[3])
        elif name == "MAX_REPEAT":
            low, high, inner = arg
            one = strings(inner)
            own = [s * n for n in sorted({low, min(max(1, low), int(high))}) for s in one]
        else:
            own = [""]  # look-arounds
        out = list(dict.fromkeys(a + b for a in out for b in own))
    return out


def test_every_form_of_a_rule_holds_its_keyword():
    for _, _, keyword, pattern in licenses.rules():
        forms = strings(_parser.parse(pattern))
        assert forms and all(re.fullmatch(pattern, f) and keyword in f for f in forms), pattern


def test_forms_behind_the_gate(spark, checkpoints):
    texts = ["No part of this publication may be reproduced.", "Reproduction in whole or in part is prohibited.", "GNU Library General Public License version 2",
             "the Library General Public License", "GNU Lesser General Public License version 2.1 only", "LGPL 2.1", "no part of it is a reproduction"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan(df).orderBy("doc_id").collect()
    ungated = [(p, label, "", pattern) for p, label, _, pattern in licenses.rules()]
    assert [tuple(r)[:7] for r in got] == [(i, *brute.licenses(t, ungated)) for i, t in enumerate(texts)]
    assert [r.labels for r in got] == ["proprietary", "proprietary", "gpl,lgpl-2", "gpl,lgpl", "gpl,lgpl-2.1-only", "lgpl-2.1", ""]


def test_given_documents_without_the_gate(spark, checkpoints):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    ungated = [(p, label, "", pattern) for p, label, _, pattern in licenses.rules()]
    want = {r.doc_id: brute.licenses(r.text, ungated) for r in docs.collect()}
    assert {r.doc_id: tuple(r)[1:7] for r in licenses.scan(docs).collect()} == want
