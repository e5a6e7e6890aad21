"""Text decoded with the wrong encoding: which words show it, and what they were.

Forms are made forward: every clean word of the corpus is run through chains of encoding
and wrong decoding.  A word of a document that equals such a form is garbled, and the word
it was made from is its original, verified by construction.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import written

# Encodings that text in UTF-8 is wrongly read as, and pairs of one-byte encodings mixed up.
READ_AS = ["cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r", "cp866", "iso8859-2", "iso8859-15", "iso8859-5", "cp1254", "mac-cyrillic"]
TWICE = ["cp1252", "latin-1", "mac-roman", "cp437", "cp1250", "cp1251"]
MIXED = [("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "cp1252"), ("koi8-r", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1250", "cp1252"), ("iso8859-2", "latin-1"), ("iso8859-2", "cp1252"), ("cp1252", "mac-roman"), ("mac-roman", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1250", "cp1251")]
LOSSY = ["cp1252", "cp1250", "cp1251", "latin-1", "ascii"]

_ODD = re.compile("[�\x80-\x9f]")
_FFFD = re.compile("�+")


def _table(name: str) -> list[str]:
    """What each byte reads as; bytes the encoding leaves open read as controls, as browsers have it."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_READ = {n: _table(n) for n in {*READ_AS, *(b for _, b in MIXED)}}
_WRITE = {n: {c: i for i, c in enumerate(t)} for n, t in {n: _table(n) for n in {*READ_AS, *(a for a, _ in MIXED)}}.items()}


def _utf8_as(word: str, name: str) -> str:
    t = _READ[name]
    return "".join(t[b] for b in word.encode("utf-8", "replace"))


def chains(word: str) -> Iterator[tuple[str, str, str]]:
    """(garbled form, chain, the spelling it was made from) of one clean word; both normal forms are garbled.

    A form in which every lost character is one mark comes with a run of marks cut to one.
    """
    for norm in ("NFC", "NFD"):
        w = unicodedata.normalize(norm, word)
        for a in READ_AS:
            one = _utf8_as(w, a)
            yield one, f"utf-8>{a}", w
            if a in TWICE:
                for b in TWICE if a in ("cp1252", "latin-1") else [a]:
                    two = _utf8_as(one, b)
                    yield two, f"utf-8>{a}>utf-8>{b}", w
                    if a == b and a in ("cp1252", "latin-1"):
                        yield _utf8_as(two, b), f"utf-8>{a} three times", w
            yield "".join(c if ord(c) > 32 and c not in "\xa0\xad" else " " for c in one), f"utf-8>{a}, blanks lost", w
        for a, b in MIXED:
            if all(c in _WRITE[a] for c in w):
                yield "".join(_READ[b][_WRITE[a][c]] for c in w), f"{a}>{b}", w
        for a in LOSSY:
            raw = w.encode(a, "replace")
            if a != "ascii":
                yield raw.decode("utf-8", "replace"), f"{a}>utf-8 with marks", w
            yield raw.decode(a), f"{a} with question marks", w
        yield w.encode("utf-8").decode("ascii", "replace"), "utf-8>ascii with marks", w
        yield w.encode("cp1252", "replace").decode("ascii", "replace"), "cp1252>ascii with marks", w


def key(form: str) -> str:
    """The form words are compared in: marks of lost characters count once in a row."""
    return _FFFD.sub("�", form)


def _letters(x: str) -> int:
    return sum(ord(c) > 127 for c in x)


def forms_of(word: str, run: bool) -> list[tuple[str, str, str, int]]:
    """Garbled forms of a word, or of a run of non-ASCII characters, that differ from it and tell: form, original, chain, doubt.

    A swap of one-byte encodings gives letters for letters.  A longer word of several tells by
    itself (doubt 0, as all that isn't a swap); of a word with one, or a short one, it takes more
    (1), and of a short one of nothing else the most (2).
    """
    out = {}
    for f, chain, made_from in chains(word):
        if "blanks lost" in chain:
            f = f.strip(" ")
            if f == word or len(f) < 2 or run and len(f) < 3:
                continue
        mixed = chain.count(">") == 1 and not chain.startswith("utf-8") and "marks" not in chain
        lost = "question" in chain
        if f in (word, unicodedata.normalize("NFC", word), unicodedata.normalize("NFD", word)) or not f or " " in f:
            continue
        doubt = 0
        if mixed and (_letters(word) < 2 or len(word) < 4):
            if run:
                continue
            doubt = 2 if _letters(word) == len(word) else 1
        if lost and (run or not re.search(r"\w\?\w", f)):
            continue
        if not lost and not any(ord(c) > 127 for c in f):
            continue
        if run and f == "�" * len(f) or not lost or "?" in f:
            out.setdefault(key(f).rstrip("?") if lost else key(f), (made_from, chain, doubt))
    return [(f, *x) for f, x in out.items()]


def suspicious(word: str) -> bool:
    """Whether a word isn't taken as a clean one: it shows marks, controls or reads back as UTF-8."""
    if _ODD.search(word):
        return True
    for a in READ_AS:
        back = _WRITE[a]
        run = [c for c in word if ord(c) > 127]
        if len(run) > 1 and all(c in back for c in run):
            raw = bytes(back[c] for c in run)
            try:
                raw.decode("utf-8")
                return True
            except UnicodeDecodeError:
                pass
    return False


def _generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got: list[tuple[str, str, str, int, int]] = []
        for unit, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if suspicious(unit):
                continue
            run = all(ord(c) > 127 for c in unit)
            got += [(*x, n) for x in forms_of(unit, False)]
            if run:
                got += [(*x, n) for x in forms_of(unit, True)]
            else:  # runs that only a decomposed spelling has
                for r in re.findall(r"[^\x00-\x7f]+", unicodedata.normalize("NFD", unit)):
                    got += [(*x, n) for x in forms_of(r, True)]
        if got:
            form, clean, chain, doubt, n_docs = zip(*got)
            yield pa.RecordBatch.from_arrays([pa.array(form), pa.array(clean), pa.array(chain), pa.array(doubt, pa.int32()), pa.array(n_docs, pa.int64())], names=["form", "clean", "chain", "doubt", "n"])


#: Example spans; a correct text may show garbled characters in one, next to the right ones in another.
_SPAN = "`[^`\\n]*`"
_NON = "[^\\x00-\\x7F]"


def units(docs: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """(doc_id, unit): the distinct words and non-ASCII runs of each text that could be garbled or clean non-ASCII."""
    text = F.col("text").cast("string")
    spans = F.filter(F.regexp_extract_all(text, F.lit(f"({_SPAN})"), F.lit(1)), lambda x: x.rlike(_NON))
    right = F.exists(spans, lambda x: ~x.rlike(f"{_NON}{_NON}") & ~x.contains("�"))
    body = F.when(right, F.regexp_replace(text, _SPAN, " ")).otherwise(text)
    src = docs.select(F.col(doc_key).cast("bigint").alias("doc_id"), body.alias("t")).where(F.col("doc_id").isNotNull() & (F.col("t").rlike(_NON) | F.col("t").rlike("[A-Za-z]\\?[a-z]")))
    marks = "[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]+"
    # Possessive and anchored at a word's start, so that a word of plain characters is passed over once.
    word = f"(?<![^ \\t\\r\\n])([\\x21-\\x7E]*+{_NON}[^ \\t\\r\\n]*)"
    asked = "(?<![^ \\t\\r\\n])([^ \\t\\r\\n]*[A-Za-z]\\?[a-z][^ \\t\\r\\n]*)"
    none = F.array().cast("array<string>")
    questions = F.when(F.contains("t", F.lit("?")), F.regexp_extract_all("t", F.lit(asked), F.lit(1))).otherwise(none)
    words = F.array_distinct(F.concat(F.regexp_extract_all("t", F.lit(word), F.lit(1)), questions))
    words = F.transform(words, lambda x: F.regexp_replace(x, f"^{marks}|{marks}$", ""))
    runs = F.regexp_extract_all("t", F.lit(f"({_NON}+)"), F.lit(1))
    every = F.array_distinct(F.concat(F.array_distinct(words), F.array_distinct(runs)))
    return src.select("doc_id", F.explode(every).alias("unit")).where("unit != ''").withColumn("unit", F.regexp_replace("unit", "�+", "�"))


def _swapped() -> Column:
    """Whether a chain is a swap of one-byte encodings."""
    return ~F.col("chain").startswith("utf-8") & ~F.col("chain").contains("marks")


def garbled(docs: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """(doc_id, unit, clean, chain): the garbled words of each document and their likeliest original.

    Of several originals of one form the one that most documents hold is taken, of equals
    the smallest; ``clean`` is null where the form is nothing but marks of lost characters.
    A word with one swapped letter, or a short one, counts if twice as many documents have the
    clean spelling, or more at all and two other words of the document are swapped alike;
    letters that stand alone count only so.

    Scale: the corpus is reduced to its distinct words with map-side combination before
    anything is generated; texts are read once into a table of their units; forms are made in parallel from that list and meet the words by
    a hash join; nothing is collected.
    """
    u, _ = written(units(docs, doc_key), "units")
    vocab = u.groupBy("unit").agg(F.count("*").alias("n"))
    # A fixed number of parts: the words are few bytes, so adaptive execution would make them one task.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forms = vocab.select("unit", "n").repartition(parts, F.xxhash64("unit")).mapInArrow(_generate, "form string, clean string, chain string, doubt int, n bigint")
    # Letters for letters could be read either way; the spelling that more documents have is the clean one.
    forms = forms.join(vocab.select(F.col("unit").alias("form"), F.col("n").alias("here")), "form").where(~_swapped() | (F.col("n") > F.col("here")))
    forms, _ = written(forms.withColumn("swapped", _swapped()), "forms")
    sure = (F.col("doubt") == 0) | (F.col("doubt") == 1) & (F.col("n") >= 2 * F.col("here"))
    likeliest = F.max(F.struct(-F.col("doubt"), "n", F.struct(F.expr("-length(clean)").alias("l"), "clean", "chain", "swapped").alias("c"))).alias("b")
    best = forms.where(sure).groupBy("form").agg(likeliest)
    best = best.select(F.col("form").alias("unit"), F.when(F.col("form") != "�", F.col("b.c.clean")).alias("clean"), F.col("b.c.chain").alias("chain"), F.col("b.c.swapped").alias("swapped"))
    told = u.join(best, "unit").select("doc_id", "unit", "clean", "chain", "swapped")
    # What is in doubt goes by two other words of the document that were swapped the same way.
    same = told.where("swapped").groupBy("doc_id", "chain").agg(F.countDistinct("unit").alias("others")).where("others > 1")
    doubtful = forms.where(~sure).join(best.select(F.col("unit").alias("form")), "form", "left_anti").withColumnRenamed("form", "unit")
    more = u.join(doubtful, "unit").join(same, ["doc_id", "chain"]).groupBy("doc_id", "unit").agg(likeliest)
    more = more.select("doc_id", "unit", "b.c.clean", "b.c.chain")
    return told.drop("swapped").unionByName(more)


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, swaps in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            for s in sorted(swaps, key=lambda s: -len(s["unit"])):
                if s["clean"] is not None:
                    pattern = "�+".join(map(re.escape, s["unit"].split("�")))
                    word = len(s["unit"]) < 4 and s["swapped"] or any(ord(c) < 128 for c in s["unit"])
                    text = re.sub(rf"(?<!\w){pattern}(?!\w)" if word else pattern, lambda m, c=s["clean"]: c, text)
            out.append(text)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "restored"])


def repair(docs: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """(doc_id, restored, n_garbled): the affected documents with originals put in where known.

    Defined results: null and empty texts and null keys are never affected; text that only
    shows garbled characters between backticks, beside a right one so shown, isn't either;
    lost characters without a known word stay as they are; repeated documents come once
    for each key and text; other columns are not read.
    """
    bad = garbled(docs, doc_key).groupBy("doc_id").agg(F.collect_set(F.struct("unit", "clean", _swapped().alias("swapped"))).alias("swaps"))
    src = docs.select(F.col(doc_key).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(bad, "doc_id")
    counts = bad.select("doc_id", F.size("swaps").alias("n_garbled"))
    fixed = src.select("doc_id", "text", "swaps").mapInArrow(_restore, "doc_id bigint, restored string")
    return fixed.join(counts, "doc_id").select("doc_id", "restored", "n_garbled")
