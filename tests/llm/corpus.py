"""Small corpora for the training-data operators."""

import random

WORDS = {
    "en": "the of and to in that is was for with this from are which their have not been other would there some time people water about many then these".split(),
    "de": "der die und das ist nicht mit ein eine auf für von sich auch werden haben nach über schön größe wasser zeit menschen straße können müssen".split(),
    "fr": "le la les des est une dans pour que qui pas avec sur été être même après très où déjà français château temps élève forêt garçon".split(),
    "es": "el la los las una que por con para del está más como pero sus años también español señor niño mañana corazón después día así".split(),
}


def sentence(rng, lang="en", n=40):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def documents(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, lang)."""
    rows = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


#: Texts at the edges that every operator must take.
EDGES = [None, "", " \n\t", "ß", "…", "x" * 30_000, "a " * 6_000, "\x00\x01 \U0001f600 \U0001f468‍\U0001f469 é", "The end.", "The end."]


def mixed(seed=1, n=24):
    rng = random.Random(seed)
    base = [sentence(rng, n=rng.randint(30, 90)) for _ in range(n)]
    near = [" ".join(w if i != 20 else "changed" for i, w in enumerate(t.split())) for t in base[:6]]
    return [*EDGES, *base, *near, *base[:4], base[5] + "\n" + base[6], base[7].upper()]
