"""Wrongly decoded text: every chain is found and undone, clean text and examples stay."""

from cairn.llm.encodings import garbled, repair

CLEAN = [
    (1, "Der größte Block überschreibt die Hälfte des Budgets – vielleicht."), (2, "L’équipe dédiée écarte la dernière exécution."), (3, "Второй исполнитель пропускает половину бюджета."),
    (4, "Pamięć łączy połowę węzła później."), (5, "The “planner” drops it’s header… → naïve ✓"), (6, "Der größte Block überschreibt die Hälfte. L’équipe dédiée."), (7, "Второй исполнитель пропускает половину. Pamięć łączy połowę węzła."),
    (8, "NÃO EDITAR O ÍNDICE À MÃO"), (9, None), (10, ""), (11, "plain ascii text?yes"), (12, "The page showed `Ã©` where x should have printed `é`."), (13, "The page showed `�` where x should have printed `°`."),
    (14, "Второй исполнитель пропускает половину бюджета."), (15, "Pamięć łączy połowę węzła później."), (16, "L’e\u0301quipe de\u0301die\u0301e"),
]


def sloppy(raw: bytes, enc: str) -> str:
    return "".join(bytes([b]).decode(enc, "ignore") or chr(b) for b in raw)


def cases():
    out, n = {}, 100
    texts = [t for i, t in CLEAN[:7]]
    for t in texts:
        for enc in ("cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp1251", "koi8-r"):
            out[n] = (sloppy(t.encode(), enc), t)
            n += 1
        out[n] = (sloppy(sloppy(t.encode(), "cp1252").encode(), "cp1252"), t)
        out[n + 1] = (t.encode().decode("ascii", "replace"), None)
        n += 2
    for a, b, t in (("cp1251", "koi8-r", texts[2]), ("koi8-r", "cp1251", texts[2]), ("cp1251", "cp1252", texts[2]), ("cp1250", "cp1252", texts[3])):
        out[n] = (sloppy(t.encode(a, "replace"), b), t)
        n += 1
    for t in texts[:2]:
        out[n] = (t.encode("cp1252", "replace").decode("utf-8", "replace"), None)
        n += 1
    out[n] = ("English text, only a bit: " + sloppy("“view”".encode(), "cp1252") + " of it.", "English text, only a bit: “view” of it.")
    return out


def test_found_and_restored(spark):
    bad = cases()
    df = spark.createDataFrame([*CLEAN, *((i, g) for i, (g, _) in bad.items())], "doc_id bigint, text string")
    assert {r.doc_id for r in garbled(df).select("doc_id").distinct().collect()} == set(bad)
    fixed = {r.doc_id: r.restored for r in repair(df).collect()}
    assert set(fixed) == set(bad)
    right = sum(fixed[i] == t for i, (_, t) in bad.items() if t)
    assert right >= 0.9 * sum(t is not None for _, t in bad.values())


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a", "b"), (None, "Ã¼ber", "a", "b"), (2, "x" * 300_000 + " Ã¼ber über über", "a", "b"), (2, "x" * 300_000 + " Ã¼ber über über", "a", "b")], "doc_id bigint, text string, unit string, clean string")
    assert {r.doc_id for r in garbled(df).collect()} == {2}
    assert repair(df.limit(0)).count() == 0


def test_words_with_one_swapped_letter(spark):
    t = "Sprawdzał listę i każdą część jeśli został."
    one = "Nazwa ostrzeżenia została później wpisana."
    bad = {10: (sloppy(t.encode("cp1250"), "cp1252"), t), 11: (sloppy(one.encode("cp1250"), "cp1252"), one)}
    same = [(20, "Une tête même"), (21, "Sur la tête"), (22, "Ένα και ê"), (23, "ę oraz ê"), (24, "ę albo ę"), (25, "ę")]
    df = spark.createDataFrame([*((i, t) for i in (1, 2)), *((i, one) for i in (3, 4)), *same, *((i, g) for i, (g, _) in bad.items())], "doc_id bigint, text string")
    assert {r.doc_id: r.restored for r in repair(df).collect()} == {i: t for i, (_, t) in bad.items()}


def test_short_words_go_by_the_others(spark):
    t = "он и вы читали документ проверяли"
    bad = sloppy(t.encode("koi8-r"), "cp1251")
    alone = "ПО Х"  # looks like a swap of short words, but nothing else of its text does
    df = spark.createDataFrame([*((i, t) for i in range(1, 6)), (6, "он и по"), (7, alone), (10, bad)], "doc_id bigint, text string")
    assert {r.doc_id: r.restored for r in repair(df).collect()} == {10: t}


def test_held_out_documents(spark):
    """Clean documents of the tables, garbled whole under chains drawn at random beside their corpus: what is restored word for word."""
    import random

    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    known = {r.doc_id for r in garbled(docs).select("doc_id").distinct().collect()}
    rnd = random.Random(12)
    clean = [r for r in docs.where("text is not null").orderBy("doc_id").collect() if r.doc_id not in known and sum(ord(c) > 127 for c in r.text) > 5 and "`" not in r.text]
    chosen = rnd.sample(clean, 80)
    chains = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac-roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp1251"), ("utf-8", "koi8-r")]
    held = []
    for k, r in enumerate(chosen):
        a, b = chains[k % len(chains)]
        held.append((10**9 + k, sloppy(r.text.encode(a), b)))
    rest = docs.where(~F.col("doc_id").isin([r.doc_id for r in chosen]))
    got = {r.doc_id: r.restored for r in repair(rest.unionByName(spark.createDataFrame(held, "doc_id bigint, text string"))).collect()}
    words = right = whole = 0
    for (i, _), r in zip(held, chosen):
        want = [w for w in r.text.split() if not w.isascii()]
        have = set((got.get(i) or "").split())
        words += len(want)
        right += sum(w in have for w in want)
        whole += got.get(i) == r.text
    assert len(got) >= 80 and set(i for i, _ in held) <= set(got)
    assert right >= 0.95 * words and whole >= 0.8 * len(held)
