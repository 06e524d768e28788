"""Personal data: fixed patterns, plus spans from a character BiLSTM with CRF transitions.

The patterns give the base spans (emails, IPv4 addresses, payment cards, phone
numbers); they always stay.  The model adds spans of the same kinds in other
spellings (national phone numbers, IPv6 addresses, cards with dots, emails with
"(at)" and "(dot)") and a fifth kind, secrets: the values of keys, tokens and
passwords.  A card that it adds must pass Luhn's test, as no tagger can compute it.

The model is trained in numpy from labelled spans, which a generator writes in the
style of the corpus; generator and sizes are parameters.  The weights of the
default parameters lie beside this module (pii_weights.npz) with those parameters,
and are trained anew where the file is missing or has others.

A span that the model adds must hold a digit, an "@" or a bracketed "at"; windows
are laid over all text within REACH characters of one.  Windows overlap by half.
Each is decoded by Viterbi, and every span is scored by its lowest marginal; spans
that a window's edge cuts are joined with what the neighbouring window has of them,
whatever their length, and dropped where no window has their end.  One pass over
all spans of a text keeps the best of those that overlap each other or a base span.

Positions are code points, ends exclusive.  Nulls count as empty texts.  Texts are
read whole.  Rows are judged one by one, so repeated rows and ids do not matter.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm import scan
from webquarry.llm.udf import text_udf, with_struct

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds that have a fixed pattern.
BASE = KINDS[:4]
# Fixed patterns of the base spans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
Span = tuple[int, int, int]  # kind's place in KINDS, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test."""
    out: list[Span] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((0, begin, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


# --- The model -------------------------------------------------------------------

#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
SYMBOLS = 98
WINDOW, REACH = 128, 64
#: Lowest marginal of a span that the model adds.
CONFIDENT = 0.75


def symbols(text: str) -> np.ndarray:
    """Symbol numbers of characters: printable ASCII apart, white space, letters beyond ASCII, the rest."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.full(len(code), 97, dtype=np.int64)
    plain = (code >= 32) & (code < 127)
    out[plain] = code[plain] - 32
    out[(code >= 9) & (code <= 13)] = 95
    out[code >= 0xC0] = 96
    return out


def _allowed() -> np.ndarray:
    """Which tag may follow which: an inside tag only its own kind."""
    ok = np.ones((TAGS, TAGS), dtype=bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@dataclass
class Tagger:
    """Weights by name: embed; in_f, rec_f, bias_f and the same for b; out, out_bias, trans."""

    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(hidden: int, embed: int, seed: int) -> Tagger:
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        w = {"embed": g(SYMBOLS, embed) * 3, "out": g(2 * hidden, TAGS), "out_bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            w |= {f"in_{d}": g(embed, 4 * hidden), f"rec_{d}": g(hidden, 4 * hidden), f"bias_{d}": bias}
        return Tagger(w)

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction over symbols (time, batch)."""
        w = self.w
        table = w["embed"] @ w[f"in_{d}"] + w[f"bias_{d}"]
        rec = w[f"rec_{d}"]
        n = rec.shape[0]
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h = c = np.zeros((x.shape[1], n), np.float32)
        states = np.zeros((*x.shape, n), np.float32)
        saved = []
        for t in steps:
            z = table[x[t]] + h @ rec
            gate = _sigmoid(z[:, : 3 * n])
            new = np.tanh(z[:, 3 * n :])
            i, f, o = gate[:, :n], gate[:, n : 2 * n], gate[:, 2 * n :]
            before, h_before = c, h
            c = f * before + i * new
            tc = np.tanh(c)
            h = o * tc
            states[t] = h
            if keep:
                saved.append((t, i, f, o, new, before, tc, h_before))
        return states, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._run(x, d, False)[0] for d in "fb"], axis=2)
        return states @ self.w["out"] + self.w["out_bias"]

    def transitions(self) -> np.ndarray:
        return np.where(_allowed(), self.w["trans"], np.float32(-1e4))

    def _alpha_beta(self, e: np.ndarray):
        a = self.transitions()
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, len(e)):
            alpha[t] = _lse(alpha[t - 1][:, :, None] + a[None], 1) + e[t]
        for t in range(len(e) - 2, -1, -1):
            beta[t] = _lse(a[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        return alpha, beta, _lse(alpha[-1], 1)

    def marginals(self, e: np.ndarray) -> np.ndarray:
        alpha, beta, z = self._alpha_beta(e)
        return np.exp(alpha + beta - z[None, :, None])

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags (time, batch)."""
        a = self.transitions()
        best, back = e[0], np.zeros((len(e), *e.shape[1:]), dtype=np.int8)
        for t in range(1, len(e)):
            s = best[:, :, None] + a[None]
            back[t] = s.argmax(axis=1)
            best = s.max(axis=1) + e[t]
        tags = np.zeros(e.shape[:2], dtype=np.int8)
        tags[-1] = best.argmax(axis=1)
        rows = np.arange(e.shape[1])
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t][rows, tags[t]]
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y, and its gradients."""
        w = self.w
        steps, batch = x.shape
        runs = {d: self._run(x, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        e = both @ w["out"] + w["out_bias"]
        alpha, beta, z = self._alpha_beta(e)
        a = self.transitions()
        rows = np.arange(batch)
        gold = e[np.arange(steps)[:, None], rows, y].sum(0) + a[y[:-1], y[1:]].sum(0)
        de = np.exp(alpha + beta - z[None, :, None])
        de[np.arange(steps)[:, None], rows, y] -= 1
        pair = np.exp(alpha[:-1][:, :, :, None] + a[None, None] + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1))
        np.subtract.at(pair, (y[:-1].ravel(), y[1:].ravel()), 1)
        de /= batch
        g = {"trans": (pair * _allowed() / batch).astype(np.float32), "out": np.tensordot(both, de, axes=([0, 1], [0, 1])), "out_bias": de.sum((0, 1)), "embed": np.zeros_like(w["embed"])}
        ds = de @ w["out"].T
        n = ds.shape[2] // 2
        for d, part in (("f", ds[:, :, :n]), ("b", ds[:, :, n:])):
            rec = w[f"rec_{d}"]
            dh = dc = np.zeros((batch, n), np.float32)
            dz_all = np.zeros((steps, batch, 4 * n), np.float32)
            g[f"rec_{d}"] = np.zeros_like(rec)
            for t, i, f, o, new, before, tc, h_before in reversed(runs[d][1]):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new**2)], axis=1)
                g[f"rec_{d}"] += h_before.T @ dz
                dh, dc = dz @ rec.T, dc * f
                dz_all[t] = dz
            by_symbol = np.zeros((SYMBOLS, 4 * n), np.float32)
            np.add.at(by_symbol, x.ravel(), dz_all.reshape(-1, 4 * n))
            g[f"bias_{d}"] = by_symbol.sum(0)
            g[f"in_{d}"] = w["embed"].T @ by_symbol
            g["embed"] += by_symbol @ w[f"in_{d}"].T
        return float((z - gold).mean()), g


class Examples:
    """Generated windows of text with labelled spans."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, items):
        return items[int(self.r.integers(len(items)))]

    def digits(self, lo: int, hi: int | None = None) -> str:
        return "".join(str(d) for d in self.r.integers(0, 10, int(self.r.integers(lo, (hi or lo) + 1))))

    def word(self, lo: int = 1, hi: int = 4) -> str:
        vowels, others = "aeiouyéüñ", "bcdfghklmnprstvwzß"
        w = "".join(self.pick(others) + self.pick(vowels) + (self.pick(others) if self.r.random() < 0.4 else "") for _ in range(int(self.r.integers(lo, hi))))
        return w.capitalize() if self.r.random() < 0.15 else w

    def ascii(self) -> str:
        return re.sub("[^a-z]", "x", self.word(1, 4).lower())

    def chars(self, alphabet: str, lo: int, hi: int | None = None) -> str:
        return "".join(self.pick(alphabet) for _ in range(int(self.r.integers(lo, (hi or lo) + 1))))

    def secret(self) -> list[tuple[str, int]]:
        """A name, what stands between, and the secret value, as labelled pieces."""
        hexes, mixed = "0123456789abcdef", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"
        if self.r.random() < 0.25:
            lead = self.pick(["AKIA", "ASIA", "ghp_", "sk-", "xoxb-", "glpat-"])
            body = self.chars("ABCDEFGHJKLMNPQRSTUVWXYZ234567", 16) if lead.endswith("IA") else self.chars(mixed, 20, 40)
            return [(lead + body, 4)]
        name = self.pick(["token", "token", "api_key", "apikey", "api-key", "secret", "secret_key", "access_token", "auth_token", "password", "passwd", "Token", "API_KEY", "client_secret"])
        between = self.pick([' = "', ' = "', '="', "='", "=", ": ", ' = ', ': "'])
        value = self.chars(hexes, *self.pick([(32, 40), (32, 64), (96, 128)])) if self.r.random() < 0.6 else self.chars(mixed, 8, 40) + self.digits(1, 2)
        close = '"' if between.endswith('"') else ("'" if between.endswith("'") else "")
        return [(name + between, -1), (value, 4), (close, -1)]

    def item(self) -> list[tuple[str, int]]:
        """Labelled pieces of text: a kind's number, or -1 for what is none, or only looks like one."""
        kind = int(self.r.integers(-4, 6))
        hexes = lambda lo, hi=None: self.chars("0123456789abcdef", lo, hi)
        if kind == 0:
            name = self.ascii() + self.pick(["", ".", "_", "-"]) + self.pick(["", self.ascii(), self.digits(1, 3)])
            host, tld = self.pick([self.ascii(), "mail" + self.digits(1) + ".example", "example", self.ascii() + "." + self.ascii()]), self.pick(["com", "org", "net", "de", "fr", "es", "io", "edu"])
            at, dot = self.pick([("@", "."), ("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", ".")])
            if self.r.random() < 0.25:  # long names
                name = ".".join([name, *(self.ascii() for _ in range(3))])
                host = ".".join([host, *(self.ascii() + self.ascii() for _ in range(2))])
            if dot != ".":
                name = name.replace(".", self.pick([".", dot]))
            return [(f"{name}{at}{host.replace('.', dot)}{dot}{tld}", 0)]
        if kind == 1:
            if self.r.random() < 0.5:
                return [(".".join(str(int(n)) for n in self.r.integers(1, 256, 4)), 1)]
            groups = [hexes(1, 4) for _ in range(8)]
            if self.r.random() < 0.5:
                groups[2:6] = [""]
            return [(":".join(groups), 1)]
        if kind == 2:
            c, sep = self.digits(16), self.pick(["", "", " ", "-", "."])
            return [(sep.join(c[i : i + 4] for i in range(0, 16, 4)), 2)]
        if kind in (3, 5):
            a, b, c = self.digits(3), self.digits(3), self.digits(4)
            area = "0" + self.digits(2, 4)
            return [(self.pick([
                f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{self.digits(2)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+49 {a} {b}{c}",
                f"{area} {self.digits(6, 8)}", f"{area}-{self.digits(6, 8)}", f"{area}/{self.digits(6, 8)}", f"({area}) {self.digits(6, 8)}", f"{area} {b} {c}", f"0{self.digits(1)} {self.digits(2)} {self.digits(2)} {self.digits(2)} {self.digits(2)}",
            ]), 3)]
        if kind == 4:
            return self.secret()
        return [(self.pick([
            lambda: f"{self.ascii()}={hexes(10, 20)}", lambda: f"{self.pick(['commit', 'sha1', 'md5', 'etag', 'revision'])}{self.pick([' ', ': ', ':'])}{hexes(32, 40)}", lambda: "-".join(hexes(n) for n in (8, 4, 4, 4, 12)),
            lambda: f"Version {self.digits(1)}.{self.digits(1)}.", lambda: f"v{self.digits(1)}.{self.digits(1, 2)}.{self.digits(1)}", lambda: f"{self.pick(['19', '20'])}{self.digits(2)}-0{self.digits(1)}-1{self.digits(1)}", lambda: f"1{self.digits(1)}:{self.pick('012345')}{self.digits(1)}:{self.pick('012345')}{self.digits(1)}",
            lambda: f"${self.digits(1, 3)},{self.digits(3)}.{self.digits(2)}", lambda: self.digits(1, 12), lambda: self.digits(1, 4), lambda: f"{self.digits(1, 4)}.{self.digits(1, 4)}", lambda: f"{self.digits(2)}/{self.digits(2)}/20{self.digits(2)}", lambda: f"({self.digits(1, 4)})", lambda: f"{self.digits(1, 3)}%", lambda: f"@{self.ascii()}", lambda: self.digits(20, 30),
            lambda: f"{self.digits(2, 6)}-{self.digits(1, 4)}", lambda: f"{self.digits(1)} + {self.digits(1, 3)}", lambda: "copyright (c) 20" + self.digits(2), lambda: f"#{self.digits(2, 6)}", lambda: f"{self.ascii()}{self.digits(1, 4)}", lambda: f"page {self.digits(1, 3)}", lambda: f"{self.digits(1, 2)}.{self.digits(1, 2)}.20{self.digits(2)}", lambda: f"{self.pick(['token', 'password', 'secret', 'key'])} {self.word()}",
        ])(), -1)]

    def window(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        text, tags = "", []

        def add(s: str, kind: int = -1) -> None:
            nonlocal text
            text += s
            tags.extend([0] * len(s) if kind < 0 else [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1))

        while len(text) < size + 40:
            if self.r.random() < 0.3:
                for piece in self.item():
                    add(*piece)
            else:
                add(self.word())
            add(self.pick([" ", " ", " ", " ", " ", " ", ", ", ". ", "\n", "*** ", "### ", "%%% ", "&&& ", "$$$ ", "!! ", "; ", " | ", ": "]))
        cut = int(self.r.integers(0, 40))
        return symbols(text)[cut : cut + size], np.array(tags[cut : cut + size])

    def batch(self, size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        rows = [self.window(size) for _ in range(count)]
        return np.stack([x for x, _ in rows], axis=1), np.stack([y for _, y in rows], axis=1)


def train(hidden: int = 32, embed: int = 16, steps: int = 900, batch: int = 48, size: int = 128, seed: int = 5) -> Tagger:
    """A tagger trained by Adam on generated windows; the same for the same parameters."""
    model, examples = Tagger.fresh(hidden, embed, seed), Examples(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    for t in range(1, steps + 1):
        _, g = model.gradients(*examples.batch(size, batch))
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        rate = 0.012 * min(1, 2 * (1 - t / (steps + 1)))
        for k, v in g.items():
            v = v * min(1, 5 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v**2
            model.w[k] = (model.w[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return model


#: Default parameters of train(), and the version of the generator; both are kept with the weights.
RECIPE = json.dumps({"generator": 3, "defaults": train.__defaults__})
WEIGHTS = Path(__file__).with_name("pii_weights.npz")


@functools.lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    """The tagger of the default parameters: read from WEIGHTS, or trained where that has no such weights."""
    if WEIGHTS.exists():
        with np.load(WEIGHTS) as held:
            if str(held["recipe"]) == RECIPE:
                return Tagger({k: held[k] for k in held.files if k != "recipe"})
    return train()


def save(model: Tagger, path: Path = WEIGHTS) -> None:
    np.savez_compressed(path, recipe=RECIPE, **model.w)


def layout(text: str, triggers: list[int]) -> list[int]:
    """Starts of overlapping windows over all text within REACH of a trigger."""
    starts: list[int] = []
    for t in triggers:
        lo, hi = max(0, t - REACH), min(len(text), t + REACH)
        at = max(lo, starts[-1] + WINDOW // 2) if starts and lo < starts[-1] + WINDOW else lo
        if starts and hi <= starts[-1] + WINDOW - WINDOW // 4:
            continue
        starts.append(at)
        while starts[-1] + WINDOW < hi:
            starts.append(starts[-1] + WINDOW // 2)
    return starts


@dataclass
class Found:
    """A span that a window has, whether the window's edges cut it, and its lowest marginal."""

    span: Span
    open_left: bool
    open_right: bool
    sure: float


def tagged_spans(tags: np.ndarray, sure: np.ndarray, start: int, length: int) -> list[Found]:
    """Spans of one window that begins at ``start``: tags, and the marginals (time, tags) of that window."""
    out = []
    s = 0
    while s < length:
        tag = int(tags[s])
        if not tag:
            s += 1
            continue
        kind = (tag - 1) // 2
        t = s + 1
        while t < length and tags[t] == 2 + 2 * kind:
            t += 1
        low = float(sure[np.arange(s, t), tags[s:t]].min())
        out.append(Found((kind, start + s, start + t), s == 0 and start > 0, t == length, low))
        s = t
    return out


def joined_spans(found: list[Found], end: int) -> list[Found]:
    """Spans of all windows of a text of ``end`` characters; parts that edges cut are joined.

    What stays open at a side is left out, but for the end of the text.
    """
    whole: list[Found] = []
    open_now: list[Found] = []  # spans whose end lies in a later window
    for f in sorted(found, key=lambda f: f.span[1:]):
        kind, a, b = f.span
        if f.open_left:
            for g in open_now:
                if g.span[0] == kind and g.span[1] <= a <= g.span[2] <= b:
                    f = Found((kind, g.span[1], b), g.open_left, f.open_right, min(f.sure, g.sure))
                    break
        if f.open_right and f.span[2] < end:
            open_now = [g for g in open_now if g.span[2] >= a] + [f]
        else:
            whole.append(f)
    return [f for f in whole if not f.open_left]


def added_spans(model: Tagger, texts: list[str], base: list[list[Span]], batch: int = 256) -> list[list[Span]]:
    """Spans that the model adds to each text's base spans."""
    windows: list[tuple[int, int, int]] = []
    for d, text in enumerate(texts):
        for a in layout(text, [m.start() for m in _TRIGGER.finditer(text)]):
            windows.append((d, a, min(len(text), a + WINDOW)))
    found: list[list[Found]] = [[] for _ in texts]
    for lo in range(0, len(windows), batch):
        part = windows[lo : lo + batch]
        x = np.full((WINDOW, len(part)), 95, dtype=np.int64)
        for j, (d, a, b) in enumerate(part):
            x[: b - a, j] = symbols(texts[d][a:b])
        e = model.emissions(x)
        tags = model.viterbi(e)
        busy = np.flatnonzero((tags > 0).any(axis=0))
        if not len(busy):
            continue
        sure = model.marginals(e[:, busy])
        for at, j in enumerate(busy):
            d, a, b = part[j]
            found[d] += tagged_spans(tags[:, j], sure[:, at], a, b - a)
    return [chosen_spans(text, base[d], joined_spans(found[d], len(text))) for d, text in enumerate(texts)]


def chosen_spans(text: str, base: list[Span], found: list[Found]) -> list[Span]:
    """The surest spans that overlap neither each other nor a base span."""
    taken = list(base)
    out: list[Span] = []
    for f in sorted(found, key=lambda f: (-f.sure, f.span)):
        kind, a, b = f.span
        value = text[a:b]
        if f.sure < CONFIDENT or value.strip() != value or not _TRIGGER.search(value):
            continue
        if KINDS[kind] == "card" and not (13 <= len(d := re.sub("[^0-9]", "", value)) <= 19 and luhn(d)):
            continue
        if all(b <= p or a >= q for _, p, q in taken):
            taken.append(f.span)
            out.append(f.span)
    return out


def _named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_HAS = scan.byte_class((0x30, 0x39), (0x40, 0x40), (0x28, 0x28), (0x5B, 0x5B))


def find_personal_data(df: DataFrame, model: Tagger | None = None, text_col: str = "text") -> DataFrame:
    """df plus n_email, n_ip, n_card, n_phone (base spans), base and spans (kind:start:end, comma-joined),
    n_secret (secrets, which only the model finds) and n_added (all spans that it adds)."""
    sent = df.sparkSession.sparkContext.broadcast(model or default_tagger())
    numbers, lists = [*(f"n_{k}" for k in KINDS), "n_added"], ["base", "spans"]
    names = [*numbers, *lists]

    def start():
        tagger = sent.value

        def one(chunk: pa.Array) -> dict:
            buf, off = scan.raw(chunk)
            total = np.concatenate([[0], np.cumsum(_HAS[buf])])
            some = np.flatnonzero(total[off[1:]] > total[off[:-1]])  # texts that can hold a span
            texts = chunk.take(pa.array(some)).to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(tagger, texts, base)
            out: dict = {n: np.zeros(len(chunk), dtype=np.int64) for n in numbers} | {n: [""] * len(chunk) for n in lists}
            for i, b, m in zip(some.tolist(), base, more, strict=True):
                for k, _, _ in b:
                    out[numbers[k]][i] += 1
                out["n_secret"][i] = sum(KINDS[k] == "secret" for k, _, _ in m)
                out["n_added"][i] = len(m)
                out["base"][i], out["spans"][i] = _named(b), _named(b + m)
            return out

        return one

    return with_struct(df, text_udf(", ".join([*(f"{n} long" for n in numbers), *(f"{n} string" for n in lists)]), start)(F.col(f"`{text_col}`").cast("string")), names)


def personal_data_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret and n_added for every row of df."""
    found = find_personal_data(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text")), model)
    return found.select(id_col, *[f"n_{k}" for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans", "n_secret", "n_added")


def mask(df: DataFrame, model: Tagger | None = None, text_col: str = "text") -> DataFrame:
    """df with every span of its text replaced by its kind in angle brackets."""
    found = find_personal_data(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")), model)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = []
            for text, named in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                if text and named:
                    parts, at = [], 0
                    for a, b, k in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in named.split(","))):
                        if a >= at:  # base spans of two kinds may overlap
                            parts += [text[at:a], f"<{k}>"]
                            at = b
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield pa.array(out, type=pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    clean = F.arrow_udf(run, returnType="string")(F.col("text"), F.col("spans"))
    return found.withColumn("clean", clean).select(*[F.col("clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])
