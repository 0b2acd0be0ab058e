"""Small documents with everything that is awkward, and plain Python versions of the contracts."""

import random
import re

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SPACED, FOLDED = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score int, shard string, start double, hash string, Label int, key array<int>"
EXTRAS = ("x", 1, "y", 0.5, "z", 7, [1])


def make_rows(seed=5, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijéñß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda k: "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 14))) for _ in range(k))
    base = [text(rng.randint(2, 25)) for _ in range(n)]
    line = "This very common line stands in a great many of the documents here."
    texts = list(base)
    texts += base[:6] + base[:3]  # exact copies
    for t in base[6:20]:  # near copies
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [line + "\n" + t for t in base[20:35]]
    texts += [line.replace("great", "graat") + "\n" + text(2), line.replace("very", "ver") + "\n" + text(2), line + "x\n" + text(2)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts += [text(3) + " " + passage + "\n" + text(2) for _ in range(5)]
    texts += [" ".join(["same"] * 70), "a b c " * 40, "one", "one two three", "ONE two", "", None, None, " \n\t ", "  x", "word " * 3 + "\r\nx", text(900)]
    texts += ["Licensed under the Apache License, Version 2.0.", "CC BY by cc by", "All rights\nreserved. GNU General Public License", "Released under the MIT License. all rights reserved"]
    rng.shuffle(texts)
    ids = rng.sample(range(10_000), len(texts))
    rows = [(i, t) for i, t in zip(ids, texts)]
    rows += [rows[3], rows[3]]  # repeated rows
    rows += [(None, base[0]), (None, None)]
    return [(i, t, rng.choice(["en", "de", None]), f"src{j % 3}", len(t) if t else None, *EXTRAS) for j, (i, t) in enumerate(rows)]


def words(text, pattern, lower=True):
    return re.findall(pattern, (text or "").translate(LOWER) if lower else text or "")
