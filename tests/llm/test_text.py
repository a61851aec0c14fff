import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.llm.prose import sections
from spectraloom.llm.subjects import _calibrate, subject_areas
from spectraloom.llm.tokens import counter, token_count


def test_counts_are_those_of_the_tokenizer(spark):
    own = counter()
    rng = random.Random(1)
    alphabet = list("ab Z1 \n\t'é~ſ  ñ中²½.,-\r s\u0301\u2003") + ["'ll", "'re", "<|endoftext|>", "  ", "\n\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(5000)] + ["word " * 20_000, "x" * 5_000, "\n" * 300]
    assert [own.count(t) for t in texts] == [len(own.encode(t)) for t in texts]
    df = spark.createDataFrame([(t,) for t in [None, "", " ", "Hello world", "<|endoftext|>"]], "text string")
    got = [r.n for r in df.select(token_count(F.col("text")).alias("n")).collect()]
    assert got[:4] == [None, 0, 1, 2] and got[4] > 1
    assert spark.createDataFrame([], "text string").select(token_count(F.col("text"))).count() == 0


def test_memory_is_bounded():
    from spectraloom.llm.tokens import VOCABULARY, TokenCounter

    small = TokenCounter(VOCABULARY, remember=50)
    for i in range(500):
        small.count(f"word{i} other{i}")
    assert len(small.parts) <= 60 and len(small.pieces) <= 60


TEX = r"""\documentclass{article}\newcommand{\gsd}{garbage collector\xspace}\newcommand{\Lap}{\mathbb{R}}
\title{Secret title}
\begin{document}
\begin{abstract} An \emph{abstract} d\'ej\`a vu. \end{abstract}
\section{Opening words}\label{sec:hidden} Plain 50\% text \cite{someone1999a} and $x = hidden$ more. % hidden comment
The \gsd\ works [veldor1999a].
\iffalse hidden passage \fi
\begin{comment} hidden too \end{comment}
\begin{equation} \alpha = hidden \end{equation} \[ hidden \] $$ hidden $$
\begin{figure}\includegraphics[width=2cm]{hidden.pdf}\caption{Visible caption}\end{figure}
\begin{thebibliography}{9} \bibitem{k} Hidden title. \end{thebibliography}
\end{document} hidden tail"""


def test_prose():
    got = sections(TEX)
    assert got[0] == ["abstract", "deja"]
    assert got[1] == ["opening", "words", "plain", "text", "and", "more", "the", "garbage", "collector", "works", "visible", "caption"]
    assert sections(TEX.replace("\n", "\r\n")) == got
    assert sections(None) == sections("") == sections("\\begin{document}\n% only a comment") == []
    assert sections("no markup at all") == [["markup", "all"]]
    assert sections("kept \\begin{align} cut off") == [["kept"]] and sections("kept \\iffalse cut off") == [["kept"]]
    assert len(sections("\\section{one} alpha " * 3000)) == 3000


WORDS = {
    "law": "court judge statute appeal tenant witness contract verdict".split(),
    "sport": "match league athlete coach sprint relay marathon referee".split(),
    "chemistry": "solvent polymer ligand crystal catalyst reagent isomer ester".split(),
}
COMMON = {"en": "the and for with from that this are was not case study model".split(), "de": "der die das und den von mit ist wird fur fall studie modell".split()}


def _corpus(rng, n):
    """Documents of sections, each about one subject; German words have a suffix."""
    docs, truth = [], {}
    for i in range(n):
        lang = "de" if rng.random() < 0.25 else "en"
        names = rng.choice([[], *([[s]] * 2 for s in WORDS), *[rng.sample(list(WORDS), 2) for _ in range(3)]])
        names = names if not names or isinstance(names[0], str) else names[0]
        parts = []
        for k in range(4):
            topic = names[k % len(names)] if names else None
            words = [rng.choice(WORDS[topic]) + ("en" if lang == "de" else "") if topic and rng.random() < 0.2 else rng.choice(COMMON[lang]) for _ in range(120)]
            if rng.random() < 0.3:
                words[5] = rng.choice(WORDS[rng.choice(list(WORDS))])  # a passing mention
            parts.append(" ".join(words))
        docs.append((i, "\\begin{document}" + "".join(f"\\section{{the}} {p}" for p in parts) + "\\begin{thebibliography} court match solvent"))
        truth[i] = set(names)
    return docs, truth


def test_subjects(spark):
    rng = random.Random(7)
    docs, truth = _corpus(rng, 500)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs] + [(900, None, "x", 1), (901, "", "x", 1), (902, "% comment", "x", 1), (None, "court", "x", 1)], "doc_id long, text string, w string, mask int")
    german = F.col("text").contains("studie")
    noise = F.pmod(F.xxhash64("doc_id"), F.lit(10))  # language null, wrong or written in another way
    df = df.withColumn("lang", F.when(noise == 0, None).when(noise == 1, "de").when(german, F.when(noise == 2, " DE ").otherwise("de")).otherwise("en"))
    labels = [(i, rng.choice([s, s.upper(), f" {s}"]), "r") for i in range(120) for s in truth[i]] + [(3, "cookery", "r"), (5, None, "r"), (None, "law", "r"), (2, "law", "r")]
    lab = spark.createDataFrame(labels, "doc_id long, subject string, rater string")
    found = subject_areas(df, "doc_id", "text", lab, list(WORDS), lang="lang")
    got = {(r.doc_id, r.subject) for r in found.assigned().collect()}
    held = {(i, s) for i in truth if i >= 120 for s in truth[i]}
    hit = {p for p in got if p[0] >= 120}
    assert len(hit & held) >= 0.97 * len(held) and len(hit - held) <= 0.03 * len(held)
    post = found.posteriors().collect()
    assert all(0 <= r.posterior <= 1 for r in post) and all(0.1 <= m <= 0.4 for m in found.midpoints)
    assert {(r.doc_id, r.subject) for r in post if r.posterior >= 0.5} == got
    assert all((r.posterior >= 0.5) == (r.share >= found.midpoints[list(WORDS).index(r.subject)]) for r in post)
    out = found.held_out().collect()
    assert out and {r.doc_id for r in out} < set(range(120)) and np.mean([(r.posterior >= 0.5) == r.labelled for r in out]) >= 0.9
    bins = found.reliability().collect()
    assert sum(r.pairs for r in bins) == len(out) and all(r.bin / 10 <= r.mean_posterior <= (r.bin + 1) / 10 for r in bins)
    comp = {r.subject: r for r in found.composition().collect()}
    assert set(comp) == {*WORDS, None} and sum(r.share for r in comp.values()) == pytest.approx(1, abs=1e-5)
    assert comp["law"].documents == sum(s == "law" for _, s in got)


def test_calibration_follows_the_labels(spark):
    """Labels that ask for half of a document put the midpoint above a quarter."""
    rng = random.Random(3)
    rows = [(i, 1 if share >= 0.35 else 0, [share]) for i in range(2000) for share in [rng.random()]]
    held = spark.createDataFrame(rows, "doc_id long, mask long, shares array<double>")
    slopes, midpoints = _calibrate(held, 1, 0.25)
    assert 0.33 <= midpoints[0] <= 0.37 and slopes[0] > 20
    assert _calibrate(held.limit(0), 2, 0.25) == ([20.0, 20.0], [0.25, 0.25])


def test_subjects_edges(spark):
    df = spark.createDataFrame([(1, "court judge statute")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, "law")], "doc_id long, subject string")
    assert subject_areas(df.limit(0), "doc_id", "text", lab, ["law"]).assigned().count() == 0
    assert subject_areas(df, "doc_id", "text", lab.limit(0), ["law", "sport"]).assigned().count() == 0
    with pytest.raises(ValueError):
        subject_areas(df, "doc_id", "text", lab, [str(i) for i in range(63)])
