"""Small tables and plain versions that the operators are held against."""

from __future__ import annotations

from fractions import Fraction

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en", first=0):
    """A documents table of the texts, with ids in their order."""
    rows = [(first + i, t, lang, f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def word_runs(text, words):
    """The set of runs of words, as text."""
    found = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for sign in "\t\n\x0b\x0c\r":
        found = found.replace(sign, " ")
    found = [w for w in found.split(" ") if w]
    if not found:
        return frozenset()
    n = min(words, len(found))
    return frozenset(" ".join(found[i : i + n]) for i in range(len(found) - n + 1))


def joined(texts, words, least):
    """doc -> (set size, component, links) by comparing all pairs."""
    sets = {doc: word_runs(text, words) for doc, text in texts.items()}
    near = {
        doc: {
            other
            for other in sets
            if other != doc
            and sets[doc]
            and sets[other]
            and Fraction(len(sets[doc] & sets[other]), len(sets[doc] | sets[other])) >= least
        }
        for doc in sets
    }
    out = {}
    for doc in sets:
        seen, todo = {doc}, [doc]
        while todo:
            for other in near[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        out[doc] = (len(sets[doc]), min(seen), len(near[doc]))
    return out
