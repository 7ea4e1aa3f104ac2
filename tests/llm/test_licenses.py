import random

from pagegrain.llm.licenses import PHRASES, scan
from tests.llm import brute


def base(text):
    words = brute.plain_words(text)
    places = []
    for line, label in PHRASES:
        own = line.split()
        places += [(k, k + len(own) - 1, label) for k in range(len(words) - len(own) + 1) if words[k : k + len(own)] == own]
    return len(words), sorted(places)


def test_phrases_like_brute_force(documents):
    draw = random.Random(9)
    pool = ["CC", "by", "General", "PUBLIC", "license", "all", "rights", "reserved", "é", "x"]
    rows = [(k, draw.choice(["", " ", "K"]).join([""]) + "".join(draw.choice(pool) + draw.choice([" ", "-", ",\n"]) for _ in range(draw.randint(0, 80)))) for k in range(60)]
    rows += [(1, None), (2, ""), (3, "--"), (4, "ccKby cc by"), (None, "All Rights Reserved"), (6, "all rights reserved"), (6, "all rights reserved"), (7, "cc"), (8, "İcc by")]
    found = scan(documents(rows)).select("doc.text", "doc.h", "n_words", "base").collect()
    assert len(found) == len(rows) and {r.h for r in found} == {"h"}
    for r in found:
        assert (r.n_words, sorted((p.first, p.last, p.label) for p in r.base)) == base(r.text)


def labels(documents, text):
    return {(p.label, p.first, p.last) for p in scan(documents([(1, text)])).select("found").first().found}


def test_templates_with_changed_words(documents):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    assert labels(documents, f"x y {grant} z") == {("mit", 2, 17)}
    assert labels(documents, grant.replace("free of charge", "free of any charge")) == {("mit", 0, 16)}
    assert labels(documents, grant.replace("hereby ", "")) == {("mit", 0, 14)}
    assert labels(documents, "Permission is hereby granted, free of charge") == set()
    assert labels(documents, "Licensed under the Apache License, Version 2.0.") == {("apache-2.0", 0, 7)}
    assert labels(documents, "public license license public of the gnu") == set()


def test_native_plan_and_empty_table(documents):
    plan = scan(documents([(1, "cc by")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert scan(documents([])).count() == 0
