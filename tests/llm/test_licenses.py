"""Licences of one family: the one that is there is named, and no other."""

import pytest

from taskloom.llm import licenses


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.n_licenses, r.licenses, r.license) for r in licenses.license_scan(df).collect()}


def test_each_template_names_itself_alone(spark):
    known = licenses.TEXTS + licenses.NOTICES
    got = scan(spark, [text for _, text in known])
    assert {i: got[i] for i in got} == {i: (1, name, name) for i, (name, _) in enumerate(known)}


@pytest.mark.parametrize("own", ["GPL-3.0", "GPL-2.0", "LGPL", "AGPL"])
def test_a_gnu_notice_names_no_relatives(spark, own):
    names = {name: text for name, text in licenses.TEXTS + licenses.NOTICES}
    name = next(n for n in names if n.startswith(own))
    prose = "this is some other text " * 20
    assert scan(spark, [f"{prose}\n# {names[name]}\n{prose}"]) == {0: (1, name, name)}


def test_licences_with_passages_of_their_own_are_all_named(spark):
    names = dict(licenses.TEXTS + licenses.NOTICES)
    pair = [n for n in names if n.startswith(("GPL-2", "GPL-3"))][:2]
    text = "\n".join([names[pair[0]], "and some parts of it, by others, come under", names[pair[1]]])
    assert scan(spark, [text])[0][:2] == (2, ",".join(sorted(pair)))
