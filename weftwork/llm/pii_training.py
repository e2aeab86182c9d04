"""Training of the tagger of problem 9, in numpy.

``labelled(text)`` gives the labelled spans: forms that are sure by their label, list of given names or shape. Sentences are
varied as they are read: letters of names, streets and addresses and all digits are drawn anew, and signs of email addresses
spelt out in ways the patterns do not know, so that the tagger learns contexts and shapes and not the words of one corpus. A
share of sentences (``MADE``) comes from templates with their labels. At most ``SAMPLE`` documents are read.

    python -m weftwork.llm.pii_training DOCUMENTS.parquet OUT.npz [SECONDS [WEIGHTS TO START FROM]]
"""

from __future__ import annotations

import multiprocessing as mp
import os
import random
import re
import sys
import time

import numpy as np

from weftwork.llm.pii import LABELS, SYMBOLS, TYPES, find, load_weights, sigmoid, symbols

#: Documents that are labelled for training at most.
SAMPLE = 6000
HELD_OUT = 400
EMBED, HIDDEN, LENGTH, BATCH = 24, 48, 160, 48
#: Share of the examples that templates give, and of email addresses that are spelt out.
MADE, SPELT = 0.15, 0.35

# How "at" and "." are spelt out, and sentences around an address {E} or a name {N}.
AT = ["[at]", " [at] ", "(at)", " (at) ", "{at}", " at ", "(ät)", " (ät) ", " [apestaart] ", " arobase ", " (собака) ", " собака "]
DOT = [".", ".", " [dot] ", "(dot)", " dot ", " punt ", " Punkt ", " (point) ", " точка "]
TEMPLATES = """
Please write to {E} about it.|Mail: {E}|Send it to {E} or call us.|Or write to {N} at {E}.|Ring {N} today.|Ask {N} whether it fits.|Copy {N} in, please.|Meet {N} and {N} at noon.|Contact {E} first.
Thank you, {N}|Schreiben Sie an {E} bitte.|Fragen Sie {N} nach dem Termin.|Rufen Sie {N} an.|Bitte an {E} senden.|Senden Sie es an {N}, nicht an {N}.|Kontakt: {E}|Danke, {N}
Stuur het naar {E} alstublieft.|Bel {N} vandaag.|Vraag {N} of het past.|Mail naar {E} of bel.|Neem contact op met {N}.|Schrijf aan {E}.|Groeten, {N}
Écrivez à {E} pour la suite.|Appelez {N} demain.|Demandez à {N} si c’est prêt.|Envoyez tout à {E}.|Merci, {N}|Contactez {N} avant midi.
Напишите на {E} до пятницы.|Позвоните {N} сегодня.|Спросите, когда придёт {N}.|Почта: {E}|С уважением, {N}|Отправьте файл на {E}.
Check the pump before start.|Prüfen Sie den Filter.|Controleer de klep eerst.|Vérifiez le joint.|Проверьте насос.|Look at page 12 at once.|Meet us at the dot on the map.
"""

# Given names, and titles before a family name.
GIVEN = (
    "Alice Anke Anna Anouk Benoît Birgit Bram Camille Edward Femke Grace Greta Heike Helen Hendrik Hélène Joost Jürgen Laura Lotte Luc Lukas Marieke Martin Matthias Nora "
    "Oliver Peter Pieter Ruben Rémi Sanne Simon Sophie Stefan Thierry Thomas Élise Андрей Анна Дмитрий Елена Игорь Марина Наталья Ольга Пётр Сергей"
).split()
_UP, _LOW = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
_SUR = rf"[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)?"
_SUR_UP = rf"[{_UP}]{{3,}}(?:-[{_UP}]{{3,}})?"
_G = "(?:" + "|".join(GIVEN) + ")"
_GU = "(?:" + "|".join(g.upper() for g in GIVEN) + ")"
_I = rf"[{_UP}]\."
NAME = re.compile(
    rf"(?<!\w)(?:{_G}(?: {_I})? {_SUR}|{_GU}(?: {_I})? {_SUR_UP}|{_SUR}, {_G}(?: {_I})?|{_SUR_UP}, {_GU}|{_G} {_I}|{_GU} {_I}|{_I} ?(?:{_I} ?)?{_SUR}|{_I} {_SUR_UP}|{_SUR} {_I}(?: ?{_I})|{_G}|{_GU})(?!\w)"
)
TITLED = re.compile(rf"(?:Mr|Ms|Mrs|Dr|Herr|Frau|mevrouw|meneer|de heer|Madame|Monsieur|г-жа|г-н|господин|госпожа)\.? ({_SUR})(?!\w)")
MAIL = re.compile(r"(?<![\w.+-])[\w.+-]+(?:@[\w-]+(?:\.[\w-]+)+|\s?[(\[]at[)\]]\s?[\w-]+(?:(?:\s?[(\[]dot[)\]]\s?|\.)[\w-]+)+)", re.I)
PHONE = re.compile(
    r"(?<![\w.-])(?:\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d[\d -]{5,12}\d|\+\d{11}|8 ?\(?\d{3}\)? ?\d{3}[ -]\d\d[ -]\d\d|07\d{3} \d{6}|\(\d{3}\) \d{3} ?\d{4}|\d{3}\.\d{3}\.\d{4}|555-\d{4}|0\d{2,3}/\d{6,8}|0\d{3} \d{7}|00\d\d \d\d \d{7}|06-\d{8}|0\d\d \d{3} \d\d \d\d|0\d(?:\.\d\d){4}|0\d(?: \d\d){4})(?![\w-]|\.\d)"
)
_ID_LABEL = r"passport no\.|Reisepass Nr\.|passeport n°|паспорт|ID card|Personalausweis(?: Nr\.)?|carte d’identité|identiteitskaart|SSN|National Insurance number:?|BSN|burgerservicenummer:?|paspoortnummer|ИНН|СНИЛС|Steuer-ID|numéro de sécurité sociale|rijbewijs(?:nummer)?"
ID = re.compile(rf"(?:{_ID_LABEL}):? ((?:[A-Z]{{2}} )?(?:\d[\d.\- ]*\d(?: [A-Z](?!\w))?|\d\dXX\d{{5}}|[A-Z]{{1,2}}\d{{7,8}}|[A-Z]\d\w{{7}}))(?!\w)")
ADDRESS = re.compile(
    r"(?<!\w)(?:(?:Flat \d+, )?\d+[A-Z]? (?:Old )?[A-Z]\w+ (?:Street|St\.|Lane|Road|Avenue)(?!\w)"
    r"|(?!Am )[A-Z]\w*(?:straat|weg|plein|laan|gracht|straße|gasse) \d+(?: ?bis|-[A-Z]|[a-z])?(?!\w)|Am [A-ZÄÖÜ]\w+ \d+[a-z]?(?!\w)"
    r"|\d+(?: bis)?, (?:rue|avenue|chemin|boulevard)(?: des?| du)?(?: Tilleuls)?(?: [A-Z]\w+)?(?!\w)"
    r"|(?:ул\.|улица) [А-ЯЁ]\w+, (?:д\.|дом) ?\d+(?:, кв\. ?\d+)?(?!\w)|[А-ЯЁ]\w+ улица, (?:д\. ?)?\d+(?:, кв\. ?\d+)?(?!\w))"
)


def labelled(text: str) -> list[tuple[int, int, str]]:
    """Spans that are sure, without overlaps."""
    taken = np.zeros(len(text) + 1, bool)
    out = []
    for kind, pattern, group in (("email", MAIL, 0), ("address", ADDRESS, 0), ("id_number", ID, 1), ("phone", PHONE, 0), ("name", NAME, 0), ("name", TITLED, 1)):
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if not taken[a:b].any():
                taken[a:b] = True
                out.append((a, b, kind))
    return sorted(out)


_SYL = ["lo", "ver", "mar", "ten", "bri", "sal", "kor", "win", "dal", "fen", "gra", "mo", "ri", "ta", "ven", "hol", "stra", "pe", "lin", "zo"]
_END = ["wick", "mere", "stone", "bergh", "mans", "son", "ton", "er", "ova", "ley", "ard", "ini", "stra", "veld", "haus", "ier", "court"]
_SYL_RU = ["ко", "ле", "ма", "ро", "ни", "са", "ва", "бер", "гор", "зим", "лу", "тар", "вол", "ден"]
_END_RU = ["ов", "ин", "енко", "ский", "як", "ук", "ич", "ева", "ина", "ский"]


def _word(rng: random.Random, like: str) -> str:
    """A new word in the script and case of another."""
    ru = "а" <= like[-1].lower() <= "я"
    parts, ends = (_SYL_RU, _END_RU) if ru else (_SYL, _END)
    w = "".join(rng.choice(parts) for _ in range(rng.randint(1, 2))) + rng.choice(ends)
    return w.upper() if like.isupper() and len(like) > 1 else w.capitalize() if like[0].isupper() else w


def spelt(address: str, rng: random.Random) -> str:
    """An email address with its signs spelt out."""
    at, dot = rng.choice(AT), rng.choice(DOT)
    name, _, host = address.partition("@")
    return name + at + host.replace(".", dot if at.strip(" ") != "at" or rng.random() < 0.3 else " dot ")


def made(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A few sentences from templates with their spans."""
    lines = [x for block in TEMPLATES.strip().split("\n") for x in block.split("|")]
    text, spans = "", []
    for line in rng.sample(lines, rng.randint(1, 3)):
        ru = any("а" <= c <= "я" for c in line)
        name = lambda like: _word(rng, like)
        for piece in re.split(r"(\{[EN]\})", line):
            if piece == "{N}":
                given = name("Ков") if ru else name("Abc")
                put, kind = rng.choice([given, f"{given} {name('Ков' if ru else 'Abc')}", f"{name('Ков' if ru else 'Abc')[0]}. {given}"]), "name"
            elif piece == "{E}":
                first, host = name("abc"), name("abc")
                mail = rng.choice([first, f"{first[0]}.{name('abc')}", f"{first}.{name('abc')}", f"{first}{rng.randint(1, 99)}", "info"]) + "@" + host + "." + rng.choice(["com", "org", "de", "nl", "fr", "ru", "example", "co.uk"])
                put, kind = spelt(mail, rng) if rng.random() < 0.7 else mail, "email"
            else:
                text += piece
                continue
            spans.append((len(text), len(text) + len(put), kind))
            text += put
        text += rng.choice([" ", "\n"])
    return text, spans


def varied(text: str, spans: list[tuple[int, int, str]], rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with other digits, and often other names, streets and mail names."""
    out, found, at, size = [], [], 0, 0

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece)

    for a, b, kind in spans:
        put(text[at:a])
        piece = text[a:b]
        if kind == "name" and rng.random() < 0.6:
            piece = re.sub(rf"[{_UP}][{_LOW}]{{2,}}|[{_UP}]{{3,}}", lambda m: m[0] if m[0].capitalize() in GIVEN and rng.random() < 0.6 else _word(rng, m[0]), piece)
        elif kind == "email" and "@" in piece and rng.random() < SPELT:
            piece = spelt(piece, rng)
        elif kind == "email" and rng.random() < 0.5:
            piece = re.sub(r"[a-z]{4,}(?=[@.\s\[(_-])", lambda m: m[0] if m[0] in ("mail", "example", "invalid", "test", "team", "info") else _word(rng, m[0]), piece)
        elif kind == "address" and rng.random() < 0.3:
            piece = re.sub(r"[A-Z][a-z]{4,}(?= (?:Street|St\.|Lane|Road|Avenue))|(?<=Tilleuls )[A-Z][a-z]+", lambda m: _word(rng, m[0]), piece)
        if rng.random() < 0.5:
            piece = re.sub(r"\d", lambda m: m[0] if m[0] in "0" and rng.random() < 0.5 else str(rng.randint(0, 9)), piece)
        found.append((size, size + len(piece), kind))
        put(piece)
        at = b
    put(text[at:])
    return "".join(out), found


def _example(text: str, spans: list[tuple[int, int, str]], rng: random.Random) -> tuple[np.ndarray, np.ndarray]:
    text, spans = varied(text, spans, rng)
    ids = symbols(text)
    y = np.zeros(len(ids), np.int64)
    for a, b, kind in spans:
        k = 1 + 2 * TYPES.index(kind)
        y[a], y[a + 1 : b] = k, k + 1
    if len(ids) > LENGTH:
        if spans and rng.random() < 0.75:
            a, b, _ = rng.choice(spans)
            at = max(0, min(len(ids) - LENGTH, rng.randint(b - LENGTH + 8, max(b - LENGTH + 8, a - 8))))
        else:
            at = rng.randint(0, len(ids) - LENGTH)
        ids, y = ids[at : at + LENGTH], y[at : at + LENGTH].copy()
        if y[0] and y[0] % 2 == 0:
            k = 0
            while k < len(y) and y[k] == y[0]:
                k += 1
            y[0] -= 1
    return ids, y


def fresh(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    n = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
    w = {"emb": n(SYMBOLS, EMBED, k=0.3), "out": n(2 * HIDDEN, LABELS, k=0.1), "outb": np.zeros(LABELS, np.float32), "trans": n(LABELS, LABELS, k=0.1), "start": np.zeros(LABELS, np.float32)}
    for d in "fb":
        w[f"wx{d}"], w[f"wh{d}"] = n(EMBED, 4 * HIDDEN, k=EMBED**-0.5), n(HIDDEN, 4 * HIDDEN, k=HIDDEN**-0.5)
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        w[f"bias{d}"] = bias
    return w


def _forward(w, ids, d):
    T, B = ids.shape
    x = w["emb"][ids]
    zx = x @ w[f"wx{d}"] + w[f"bias{d}"]
    h, c = np.zeros((B, HIDDEN), np.float32), np.zeros((B, HIDDEN), np.float32)
    hs, cs, gs = np.empty((T, B, HIDDEN), np.float32), np.empty((T, B, HIDDEN), np.float32), np.empty((T, B, 4 * HIDDEN), np.float32)
    prev_h, prev_c = np.empty_like(hs), np.empty_like(cs)
    live = (ids != 0).astype(np.float32)[:, :, None]
    for t in range(T - 1, -1, -1) if d == "b" else range(T):
        prev_h[t], prev_c[t] = h, c
        z = zx[t] + h @ w[f"wh{d}"]
        g = np.concatenate([sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])], 1)
        c2 = g[:, HIDDEN : 2 * HIDDEN] * c + g[:, :HIDDEN] * g[:, 3 * HIDDEN :]
        gs[t], cs[t] = g, c2
        c = c + live[t] * (c2 - c)
        h = h + live[t] * (g[:, 2 * HIDDEN : 3 * HIDDEN] * np.tanh(c2) - h)
        hs[t] = h
    return hs, (x, gs, cs, prev_h, prev_c, live)


def _backward(w, grads, ids, d, dhs, cache):
    x, gs, cs, prev_h, prev_c, live = cache
    T, B = ids.shape
    dh, dc = np.zeros((B, HIDDEN), np.float32), np.zeros((B, HIDDEN), np.float32)
    dzs = np.empty((T, B, 4 * HIDDEN), np.float32)
    wht = w[f"wh{d}"].T.copy()
    for t in range(T) if d == "b" else range(T - 1, -1, -1):
        dh = dh + dhs[t]
        m = live[t]
        g, c2 = gs[t], cs[t]
        i, f, o, a = (g[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        tc = np.tanh(c2)
        dhn = dh * m
        dc2 = dc * m + dhn * o * (1 - tc * tc)
        dz = np.concatenate([dc2 * a * i * (1 - i), dc2 * prev_c[t] * f * (1 - f), dhn * tc * o * (1 - o), dc2 * i * (1 - a * a)], 1)
        dzs[t] = dz
        dh = dh * (1 - m) + dz @ wht
        dc = dc * (1 - m) + dc2 * f
    flat = dzs.reshape(T * B, -1)
    grads[f"wh{d}"] += prev_h.reshape(T * B, -1).T @ flat
    grads[f"wx{d}"] += x.reshape(T * B, -1).T @ flat
    grads[f"bias{d}"] += flat.sum(0)
    np.add.at(grads["emb"], ids.reshape(-1), flat @ w[f"wx{d}"].T)


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def crf_loss(w, grads, em, ys, live):
    """Mean negative log likelihood of the label sequences; gives the scores' gradient."""
    T, B, K = em.shape
    alpha = np.empty((T, B, K), np.float32)
    alpha[0] = w["start"] + em[0]
    for t in range(1, T):
        nxt = _lse(alpha[t - 1][:, :, None] + w["trans"][None], 1) + em[t]
        alpha[t] = np.where(live[t], nxt, alpha[t - 1])
    logz = _lse(alpha[-1], 1)
    beta = np.zeros((B, K), np.float32)
    dem = np.zeros_like(em)
    dtrans = np.zeros((K, K), np.float32)
    rows = np.arange(B)
    for t in range(T - 1, -1, -1):
        p = np.exp(alpha[t] + beta - logz[:, None])
        dem[t] = p * live[t]
        if t:
            inner = em[t] + beta
            pair = np.exp(alpha[t - 1][:, :, None] + w["trans"][None] + inner[:, None, :] - logz[:, None, None]) * live[t][:, :, None]
            dtrans += pair.sum(0)
            beta = np.where(live[t], _lse(w["trans"][None] + inner[:, None, :], 2), beta)
    gold = w["start"][ys[0]] + em[0, rows, ys[0]]
    for t in range(T):
        on = live[t][:, 0]
        dem[t, rows[on], ys[t, on]] -= 1
        if t:
            gold = gold + np.where(on, w["trans"][ys[t - 1], ys[t]] + em[t, rows, ys[t]], 0)
            np.subtract.at(dtrans, (ys[t - 1, on], ys[t, on]), 1)
    start = np.exp(alpha[0] * 0) * dem[0]
    grads["trans"] += dtrans / B
    grads["start"] += start.sum(0) / B
    return float((logz - gold).mean()), dem / B


def gradient(w, batch):
    T = max(len(a) for a, _ in batch)
    ids, ys = np.zeros((T, len(batch)), np.int64), np.zeros((T, len(batch)), np.int64)
    for k, (a, y) in enumerate(batch):
        ids[: len(a), k], ys[: len(y), k] = a, y
    live = np.zeros((T, len(batch), 1), bool)
    for k, (a, _) in enumerate(batch):
        live[: len(a), k] = True
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    f, cf = _forward(w, ids, "f")
    b, cb = _forward(w, ids, "b")
    both = np.concatenate([f, b], 2)
    em = both @ w["out"] + w["outb"]
    loss, dem = crf_loss(w, grads, em, ys, live)
    grads["out"] += both.reshape(-1, 2 * HIDDEN).T @ dem.reshape(-1, LABELS)
    grads["outb"] += dem.sum((0, 1))
    dboth = dem @ w["out"].T
    _backward(w, grads, ids, "f", dboth[:, :, :HIDDEN], cf)
    _backward(w, grads, ids, "b", dboth[:, :, HIDDEN:], cb)
    return loss, grads


_data: list = []


def _work(job):
    w, seed = job
    rng = random.Random(seed)
    return gradient(w, [_example(*(made(rng) if rng.random() < MADE else rng.choice(_data)), rng) for _ in range(BATCH)])


def scored(texts: list[str], path: str) -> dict[str, float]:
    """Precision and recall of whole spans against the labelled ones."""
    got = {(i, *s) for i, f in enumerate(find(texts, path)) for s in f}
    want = {(i, *s) for i, t in enumerate(texts) for s in labelled(t)}
    return {"precision": len(got & want) / max(1, len(got)), "recall": len(got & want) / max(1, len(want)), "spans": len(want)}


def train(texts: list[str], out: str, seconds: float = 400, workers: int = 8, begin: str | None = None) -> dict[str, float]:
    """Weights from labelled texts, written to ``out``; from those of ``begin`` on, with smaller steps, if given."""
    rng = random.Random(11)
    texts = sorted(set(texts))
    rng.shuffle(texts)
    held, texts = texts[:HELD_OUT], texts[HELD_OUT : HELD_OUT + SAMPLE]
    pieces = []
    for t in texts:
        # long texts are read in parts, so that each part is drawn alike
        parts = [t[a : a + 600] for a in range(0, len(t), 600)] if len(t) > 900 else [t]
        pieces += [(p, labelled(p)) for p in parts]
    _data[:] = [p for p in pieces if p[1]] + rng.sample([p for p in pieces if not p[1]], min(len(pieces) // 6, sum(not p[1] for p in pieces)))
    w, most = fresh(), 0.006
    if begin:
        w, most = {k: x for k, x in load_weights(begin).items() if k in w}, 0.002
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in "mv")
    began, step = time.time(), 0
    with mp.get_context("fork").Pool(workers) as pool:
        while (gone := (time.time() - began) / seconds) < 1:
            step += 1
            results = pool.map(_work, [(w, step * 1000 + i) for i in range(workers)], 1)
            rate = most * min(1, step / 20) * (0.03 + 0.97 * (1 - gone))
            for k in w:
                g = sum(r[1][k] for r in results) / len(results)
                g *= min(1.0, 1.0 / (np.sqrt((g * g).sum()) + 1e-6))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
            if step % 50 == 0:
                print(step, round(time.time() - began), "loss", round(float(np.mean([r[0] for r in results])), 3), flush=True)
    np.savez_compressed(out, **{k: x.astype(np.float16) for k, x in w.items()})
    load_weights.cache_clear()
    return scored(held, out)


if __name__ == "__main__":
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    import pyarrow.parquet as pq

    docs = pq.read_table(sys.argv[1], columns=["text"]).column("text").to_pylist()
    print(train([d for d in docs if d], sys.argv[2], float(sys.argv[3]) if len(sys.argv) > 3 else 400, begin=sys.argv[4] if len(sys.argv) > 4 else None))
