"""A rule's keyword is in whatever its pattern matches."""

from itertools import product
from re import _parser

from helpers import documents

from planloom.llm import licenses


def spelled(tokens):
    """Texts of a parsed pattern: each alternative, each optional part with and without."""
    parts = []
    for kind, value in tokens:
        kind = str(kind)
        if kind == "LITERAL":
            parts.append([chr(value)])
        elif kind == "IN":
            parts.append([chr(v) if str(k) == "LITERAL" else "1" for k, v in value])
        elif kind == "BRANCH":
            parts.append([t for branch in value[1] for t in spelled(branch)])
        elif kind == "SUBPATTERN":
            parts.append(spelled(value[-1]))
        elif kind == "MAX_REPEAT":
            parts.append(["", *spelled(value[2])] if value[0] == 0 else spelled(value[2]))
        else:
            assert kind == "ASSERT_NOT", kind
    return ["".join(p) for p in product(*parts)]


def test_each_alternative_has_its_keyword():
    wrong = [(r.keyword, t) for r in licenses.rules() for t in spelled(_parser.parse(r.pattern)) if r.keyword not in f" {t} "]
    assert not wrong, wrong[:9]


def test_x11_and_expat(spark):
    rows = [(1, "Expat License"), (2, "the X11 licence applies"), (3, "other words")]
    assert [(r.doc_id, r.labels) for r in licenses.scan(documents(spark, rows)).orderBy("doc_id").collect()] == [(1, "mit"), (2, "mit"), (3, "")]
