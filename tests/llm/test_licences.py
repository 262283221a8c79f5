import random

from wavemill.llm import licence_texts, licences


def test_nearest_directory_nulls_and_ties(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        ("LICENSE", mit), ("a/LICENSE.txt", apache), ("a/b/x.py", "code"), ("a/b/c/y.py", f"# {mit}\ncode"), ("z/x.py", None), ("a/x.py", ""),
        ("ab/x.py", "code"), (None, "code"), (None, mit), ("dup", "code"), ("dup", "code"), ("d/COPYING", f"{apache}\n{mit}"), ("d/e", "licence of some other kind entirely unknown here"),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "path string, text string, score string")
    out = licences.scan(df)
    assert out.columns == ["path", "text", "licence", "score", "origin", "licence_from"]
    got = {(r.path, r.text): (r.licence, r.origin, r.licence_from) for r in out.collect()}
    assert out.count() == len(rows)
    assert got["a/b/x.py", "code"] == ("Apache-2.0", "directory", "a") and got["a/x.py", ""] == ("Apache-2.0", "directory", "a")
    assert got["a/b/c/y.py", f"# {mit}\ncode"] == ("MIT", "own", None)
    assert got["z/x.py", None] == ("MIT", "directory", "") and got["ab/x.py", "code"] == ("MIT", "directory", "") and got["dup", "code"][0] == "MIT"
    assert got[None, "code"] == (None, None, None) and got[None, mit] == ("MIT", "own", None)
    assert got["d/e", rows[-1][1]][1:] == ("directory", "d")
    assert licences.scan(df.limit(0)).count() == 0


def altered(text, rng, share):
    """The text wrapped anew as a comment, with some words gone and some put in."""
    words = [w for w in text.split() if rng.random() > share / 2]
    for _ in range(int(len(words) * share / 2)):
        words.insert(rng.randrange(len(words) + 1), rng.choice(("notice", "hereby", "project", "2024", "contributors")))
    return words


def test_altered_licences_are_found(spark):
    rng, rows, expected = random.Random(3), [], {}
    prose = "the of and to in that it was for on with as he she they a is not by at from we had this which or an were would there their".split()
    for i in range(400):
        rows.append((f"p{i}/LICENSE", " ".join(rng.choice(prose) + (f"{rng.randrange(500)}" if rng.random() < 0.6 else "") for _ in range(rng.randrange(20, 400)))))
    for i, (name, text) in enumerate(t for t in licences.TEMPLATES for _ in range(3) if len(t[1].split()) > 25):
        words = altered(text, rng, 0.2)
        lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
        if i % 3:
            rows.append((f"f{i}/LICENSE.txt", "\n".join(lines)))
        else:
            mark = rng.choice(("# ", "// ", " * "))
            rows.append((f"f{i}/x.py", ("/*\n" if mark == " * " else "") + "\n".join(mark + x for x in lines) + ("\n */" if mark == " * " else "") + "\n\nimport os\nprint(1)\n"))
        expected[rows[-1][0]] = name
    got = {r.path: (r.licence, r.origin) for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    right = sum(got[path] == (name, "own") for path, name in expected.items())
    assert right >= 0.9 * len(expected), (right, len(expected), [(p, n, got[p]) for p, n in expected.items() if got[p][0] != n])
    assert all(got[f"p{i}/LICENSE"] == (None, None) for i in range(400))


def test_openings_of_files_and_no_word_needed(spark):
    bsd = licences.TEMPLATES[9][1]
    rows = [("a/LICENSE", bsd.split("\n\n", 1)[1]), ("a/b.c", "int x;"), ("b/COPYING", "Redistribution and use"), ("c/x.c", licence_texts.MPL_NOTICE.replace(". ", ".\n// ").join(("// ", "\nint y;")))]
    got = {r.path: r.licence for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/LICENSE": "BSD-2-Clause", "a/b.c": "BSD-2-Clause", "b/COPYING": None, "c/x.c": "MPL-2.0"}


def test_clashing_names_long_texts_and_repeats(spark):
    long = "# comment\n" * 50_000 + "x " * 500_000
    rows = [("a/x", long, "o", "k"), ("a/x", long, "o", "k"), (None, "", "o", None), (None, None, None, None), ("a/LICENSE", licence_texts.MIT, "o", "k")]
    df = spark.createDataFrame(rows, "path string, text string, own string, key string")
    out = licences.scan(df)
    assert out.columns == ["path", "text", "own", "key", "licence", "score", "origin", "licence_from"]
    got = sorted(str((r.path, r.own, r.key, r.licence, r.origin)) for r in out.collect())
    assert got == sorted(map(str, [("a/x", "o", "k", "MIT", "directory")] * 2 + [(None, "o", None, None, None), (None, None, None, None, None), ("a/LICENSE", "o", "k", "MIT", "own")]))
