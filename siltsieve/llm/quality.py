"""Statistics of each document's text that tell prose from lists, tables and junk, with a reason per failed rule.

Method: the characters of a batch form one array of classes whose counts per document are reduced at once
(letters, digits, symbols, blanks); lines are sorted into row, entry, noise and prose by separators, marks,
length, end punctuation and word shapes; common words come from a given list. Fixed thresholds in the manner
of published heuristic filters turn the statistics into named failures, and the share of the text in rows,
entries and noise decides the kind.

Defined edge cases: null, empty and blank texts have zero statistics, no failure and no kind; markup and
quoting marks count as symbols but their content is judged; texts of any length are read whole, and the statistics
are those of the whole text; only for the kind and the failed rules the author's signature at the end (see
``signature_lines``) is left out; ties between kinds go to junk, then table, then list.
"""

from __future__ import annotations

import html
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_COMMON_WORDS = 100_000
#: Fixed thresholds of the rules; shares are of characters unless said otherwise. Form and several bounds follow the
#: published heuristic filters of large web corpora (the quality rules of MassiveText, Rae et al. 2021: mean word length,
#: symbols to words, share of bullet lines above 0.9, common words; the line and repetition rules of C4 and MassiveText);
#: they are set looser here, as posts are short. The kinds are decided by these recorded failures alone.
MOST = 0.5
RULES = {
    "rows": ("row_share", ">", MOST), "entries": ("entry_share", ">", MOST), "noise": ("noise_share", ">", MOST),
    "few_letters": ("letter_ratio", "<", 0.45), "many_symbols": ("symbol_ratio", ">", 0.35), "word_length": ("mean_word_length", ">", 14.0),
    "no_common_words": ("common_share", "<", 0.02), "bullets": ("bullet_share", ">", 0.9), "short_lines": ("short_line_share", ">", 0.8), "repetition": ("repeat_share", ">", 0.6),
}
STATS = ["n_chars", "n_words", "n_lines", "mean_word_length", "letter_ratio", "digit_ratio", "symbol_ratio", "end_punctuation_share", "bullet_share", "short_line_share", "common_share", "distinct_word_share", "repeat_share", "row_share", "entry_share", "noise_share", "broken_share", "odd_word_share"]

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_BULLET = re.compile(r"^\s*(?:[-*•·‣▪◦–—+>»○●■□✓✔・※→]\s*\S|\[[ xX*]?\]\s*\S|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)]\s+\S|#\d+\s|☐|☑)")
_MARK = re.compile(r"^\s*(?:[-*•·‣▪◦–—+»○●■□✓✔・※→☐☑]+|\[[ xX*]?\]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)]|#\d+)\s*")
_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s*$")
_QUOTE = re.compile(r"^(?:\s*>)+ ?")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|\[/?(?:quote|b|i|u|url|img|code|list|size|color|spoiler)(?:=[^\[\]]*)?\]", re.I)
_CELLS = re.compile(r"<t[dh][^>]*>", re.I)
_URL = re.compile(r"https?://\S+", re.I)
_BROKEN = re.compile(r"[�\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]|[ÃÂâåæçäãéèê][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|[Ã][^\s\w]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_HEX = re.compile(r"(?<!\S)(?:0x)?[0-9a-fA-F]{2,}(?!\S)")
#: what a token of code holds, found in whole lines: each match reaches to the end of its token
_CODE = re.compile(r"(?:0x[0-9a-fA-F]+|\d{1,2}:\d{2}:\d{2}|(?<!\S)\[?\d{4,}[.\]]|[A-Za-z]\w*(?:[._:/=$#]+\w+)+[(=:]|\w+\([^)\s]*[:.,]|\w=[^\s=]|(?<!\S)[\w.-]*/[\w./-]+/|[{}<>;](?!\S)|(?<!\S)[{}<>]|\w+::\w+|\w+->\w+|(?<!\S)\w+(?:\.\w+){2,})\S*")
_MAYBE_CODE = re.compile(r"0x|[{}<>;]|\w[._:/=$#(-]+[^\s.]|/[\w./-]|(?<!\S)\[?\d{4,}[.\]]")
_DIGIT = re.compile(r"[0-9]")
_ASCII_LETTERS = string.ascii_letters.encode()
#: end marks or capitals inside a word
_ODD = re.compile(r"[A-Z.,;?!](?:(?<=[a-zß-ÿ][A-Z])|(?<=[^\W\d_][.,;?!])(?=[^\W\d_])|(?<!\S.)(?<=[.,;?!])(?=[^\W\d_]))\S*")
_SIGN = re.compile(r"^\s*(?:-- ?|-{3,}|_{3,}|~{3,}|={3,}|\*{3,})\s*$")
_QUOTE_END = re.compile(r"\[/quote\]|</blockquote>", re.I)
#: Lines of a signature after its sign line, and characters of each, at most.
SIGN_LINES, SIGN_CHARS = 3, 80
_SEPARATORS = [re.compile(p) for p in (r"\s*\|\s*", r"\t", r"\s*;\s*", r"\s+/\s+", r" {2,}", r"\s*,\s*", r"\s*::\s*|\s+~\s+|\s*¦\s*", r"\s+-\s+|\s+–\s+")]
#: texts one of which a line must hold to be parted by the separator of the same place
_HINTS = [("|",), ("\t",), (";",), ("/",), ("  ",), (",",), ("::", "~", "¦"), ("-", "–")]


def text_lines(text: str) -> list[str]:
    """Lines with quoting marks, markup and entities taken off; table cells of markup become tabs."""
    if "<" in text or "[" in text or "&" in text:
        text = re.sub(r"<br\s*/?>[ \t]*\n", "\n", text, flags=re.I)
        text = re.sub(r"<br\s*/?>", " " if "\n" in text else "\n", text, flags=re.I)
        text = re.sub(r"</t[dh]>\s*<t[dh][^>]*>", "\t", text, flags=re.I)
        text = re.sub(r"</?(?:tr|li|p|div|h\d)[^>]*>", lambda m: "\n" if m[0][1] == "/" else ("\n- " if m[0][1:3].lower() == "li" else "\n"), text, flags=re.I)
        text = re.sub(r"\[/?quote(?:=[^\[\]]*)?\]", "\n", text, flags=re.I)
        text = html.unescape(_TAG.sub("", text))
    return [s for s in (_QUOTE.sub("", line).rstrip() for line in text.split("\n")) if s.strip()]


def signature_lines(text: str, lines: list[str]) -> int:
    """How many of the last lines are the author's signature: a sign line outside quotes and few short lines to the end.

    The signature of a quoted post is none, nor is a block that holds rows, marked entries or whole sentences.
    """
    at = next((i for i in range(len(lines) - 1, max(0, len(lines) - SIGN_LINES - 2), -1) if _SIGN.match(lines[i])), None)
    if at is None:
        return 0
    block = lines[at + 1 :]
    if any(len(x) > SIGN_CHARS or _BULLET.match(x) or re.search(r"[.!?…。！？]$", x) for x in block) or any(row_lines(lines)[at + 1 :]):
        return 0
    raw = [x for x in text.split("\n") if x.strip()]
    last = next((i for i in range(len(raw) - 1, -1, -1) if _SIGN.match(_TAG.sub("", _QUOTE.sub("", raw[i])))), None)
    if last is None or any(_QUOTE.match(x) for x in raw[last:]) or _QUOTE_END.search("\n".join(raw[last:])):
        return 0
    return len(lines) - at


def row_lines(lines: list[str]) -> list[bool]:
    """Which lines are rows of cells: a separator that gives the same number of short cells in at least three lines."""
    out, joined = [False] * len(lines), "\n".join(lines)
    for k, (sep, hints) in enumerate(zip(_SEPARATORS, _HINTS, strict=True)):
        if not any(h in joined for h in hints):
            continue
        held = [hints[0] in x for x in lines] if len(hints) == 1 else [any(h in x for h in hints) for x in lines]
        if sum(held) < 3:
            continue
        parts = [(sep.split(x.strip().strip("|") if k == 0 else x.strip(" ")) if h else [x]) for x, h in zip(lines, held, strict=True)]
        least = 2 if k in (0, 1) else 3
        counts = Counter(len(p) for p in parts if len(p) >= least)
        if not counts:
            continue
        n, times = max(counts.items(), key=lambda c: (c[1], c[0]))
        if times < 3:
            continue
        hit = [i for i, p in enumerate(parts) if len(p) == n and sum(len(c) for c in p) / n <= 30]
        if k in (3, 4, 5, 6, 7):  # separators that also occur in prose: cells are short and do not read on
            hit = [i for i in hit if max(len(c.split()) for c in parts[i]) <= 5 and not _END.search(lines[i])]
        if len(hit) >= 3 and len(hit) >= 0.5 * sum(len(p) > 1 for p in parts):
            for i in hit:
                out[i] = True
            for i, x in enumerate(lines):  # rules between rows
                if re.fullmatch(r"[\s|+=:_-]{3,}", x):
                    out[i] = True
    return out


def noise_line(line: str) -> bool:
    """True for a line no person would read: encoded or machine output, symbols only, broken encoding."""
    s = (_URL.sub("", line) if "://" in line else line).strip()
    tokens = s.split()
    dense = sum(map(len, tokens))
    if dense < 4:
        return False
    if max(map(len, tokens)) > 28 and sum(len(t) for t in tokens if len(t) > 28 and not _CJK.search(t)) > 0.6 * dense:
        return True
    # tokens of hexadecimal digits have a decimal one or are pairs
    if len(tokens) >= 3 and (dense <= 3.5 * len(tokens) or _DIGIT.search(s)) and sum(len(t) for t in _HEX.findall(s) if len(t) == 2 or _DIGIT.search(t)) > 0.6 * dense:
        return True
    if not s.isascii():
        if len(_BROKEN.findall(s)) * 2 > 0.25 * dense:
            return True
        if _CJK.search(s):
            return False
    elif not s.isprintable() and len(_BROKEN.findall(s)) * 2 > 0.25 * dense:
        return True
    if dense >= 12 and _few_letters(s, dense):
        return True
    return dense >= 8 and _MAYBE_CODE.search(s) is not None and _code_size(s) > 0.5 * dense


def _few_letters(s: str, dense: int) -> bool:
    if s.isascii() and len(s) - len(s.encode().translate(None, _ASCII_LETTERS)) >= 0.4 * dense:
        return False
    return sum(map(len, _WORD.findall(s))) < 0.4 * dense


def _code_size(s: str) -> int:
    """Characters of the tokens that hold code."""
    total = 0
    for m in _CODE.finditer(s):
        a = m.start()
        while a and not s[a - 1].isspace():
            a -= 1
        total += m.end() - a
    return total


def analyse(text: str | None, known: set[str]) -> dict[str, float]:
    """Line and word statistics of one whole text."""
    lines = text_lines(text) if text and text.strip() else []
    return _measure(text, lines, known) if lines else dict.fromkeys(STATS, 0.0)


def both(text: str | None, known: set[str]) -> tuple[dict[str, float], dict[str, float]]:
    """The statistics of the whole text, and those that decide its kind: without the signature."""
    lines = text_lines(text) if text and text.strip() else []
    if not lines:
        return dict.fromkeys(STATS, 0.0), dict.fromkeys(STATS, 0.0)
    whole, n = _measure(text, lines, known), signature_lines(text, lines)
    return whole, _measure(text, lines[: len(lines) - n], known) if 0 < n < len(lines) else dict(whole)


def _measure(text: str, lines: list[str], known: set[str]) -> dict[str, float]:
    out = dict.fromkeys(STATS, 0.0)
    cjk = 0 if text.isascii() else len(_CJK.findall(text))
    size = [sum(map(len, x.split())) for x in lines]
    total = max(1, sum(size))
    rows = row_lines(lines) if len(lines) >= 3 else [False] * len(lines)
    noise = [not r and noise_line(x) for x, r in zip(lines, rows, strict=True)]
    bullets = [bool(_BULLET.match(x)) for x in lines]
    ends = [bool(_END.search(x)) for x in lines]
    # an entry: few words, no end of sentence; two entries in a row at least
    short = []
    for x, e, r, n in zip(lines, ends, rows, noise, strict=True):
        body = _MARK.sub("", x)
        few = len(body) <= 22 if cjk and _CJK.search(body) else len(body) <= 56 and len(body.split()) <= 8
        short.append(few and not e and not r and not n and len(body) > 0 and not body.endswith(","))
    entry = [s and ((i > 0 and short[i - 1]) or (i + 1 < len(short) and short[i + 1])) for i, s in enumerate(short)]
    joined = "\n".join(lines)
    joined = _URL.sub(" ", joined) if "://" in joined else joined
    low = [w.lower() for w in _WORD.findall(joined)]
    share = lambda flags: sum(s for s, f in zip(size, flags, strict=True) if f) / total
    if low:
        grams = Counter(zip(low, low[1:], low[2:], strict=False))
        repeated = sum(c for c in grams.values() if c > 1)
        out["repeat_share"] = repeated / max(1, len(low) - 2)
        out["distinct_word_share"] = len(set(low)) / len(low)
        out["mean_word_length"] = sum(map(len, low)) / len(low)
        out["common_share"] = sum(w in known for w in low) / len(low)
    if cjk > 0.3 * total:
        # unsegmented text: common words are looked for inside it
        out["common_share"] = max(out["common_share"], min(1.0, sum(text.count(w) for w in known if _CJK.match(w)) / max(1, cjk / 8)))
    out |= {
        "n_words": float(len(low)), "n_lines": float(len(lines)), "end_punctuation_share": sum(ends) / len(lines), "bullet_share": sum(bullets) / len(lines), "short_line_share": sum(short) / len(lines),
        "row_share": share(rows), "entry_share": share(entry), "noise_share": share(noise), "broken_share": 2 * len(_BROKEN.findall(text)) / max(1, total),
    }
    out["odd_word_share"] = len(_ODD.findall(joined)) / max(1, sum(map((1).__lt__, map(len, joined.split()))))
    out["cjk_share"] = cjk / total
    out["n_distinct"] = float(len(set(low)))
    out["distinct_lines"] = len(set(lines)) / len(lines)
    out["n_entries"] = float(sum(entry))
    return out


def judge(s: dict[str, float]) -> tuple[str | None, list[str]]:
    """Kind and failed rules of one document's statistics."""
    if not s["n_lines"]:
        return None, []
    cjk = s.get("cjk_share", 0.0) > 0.3
    failed = []
    for rule, (stat, op, bound) in RULES.items():
        if cjk and rule in ("word_length", "no_common_words", "repetition"):
            continue
        if rule in ("no_common_words", "repetition") and s["n_words"] < 12:
            continue
        if (s[stat] > bound) if op == ">" else (s[stat] < bound):
            failed.append(rule)
    structured = s["row_share"] + s["entry_share"]
    if not cjk and s["n_words"] >= 8 and s["common_share"] < 0.1 and s["odd_word_share"] > 0.08:
        failed.append("odd_words")
    if s["broken_share"] > 0.25:
        failed.append("broken_encoding")
    babble = s["n_words"] >= 8 and s["distinct_word_share"] <= 0.25 and s.get("n_distinct", 0) <= 25 and s["repeat_share"] > 0.9
    if babble and not (s["bullet_share"] > 0.8 and s["distinct_lines"] > 0.6):
        failed.append("same_words")
    # a structure may excuse what is noise in running text
    excused = {"no_common_words": structured >= MOST, "odd_words": structured >= MOST, "same_words": s["row_share"] >= MOST, "few_letters": structured >= 0.3 or cjk, "word_length": s["row_share"] >= MOST}
    if any(rule in failed and not excused.get(rule, False) for rule in ("noise", "broken_encoding", "no_common_words", "odd_words", "same_words", "few_letters", "word_length")):
        return "junk", failed
    if "rows" in failed:
        return "table", failed
    if "entries" in failed and s["n_entries"] >= 3:
        return "list", failed
    return None, failed


def char_counts(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Characters, letters, digits and symbols (no blanks) of each text, by one pass over the batch's code points."""
    joined = "\x00".join(t.replace("\x00", " ") for t in texts) + "\x00"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    uniq = np.flatnonzero(seen)
    kinds = np.zeros((4, 0x110000), np.uint8)
    kinds[:, uniq] = np.array([[c.isalpha(), c.isdigit(), not (c.isalnum() or c.isspace() or c == "\x00"), not c.isspace() and c != "\x00"] for c in map(chr, uniq)], np.uint8).T
    ends = np.flatnonzero(codes == 0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return ends - starts, *(np.add.reduceat(kinds[k][codes], starts, dtype=np.int64) for k in range(4))


def text_quality(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document STATS, ``failed`` (array of rule names) and ``kind`` (list, table, junk or null)."""
    rows = common_words.select(F.lower("word")).distinct().limit(MAX_COMMON_WORDS + 1).collect()
    if len(rows) > MAX_COMMON_WORDS:
        raise ValueError("too many common words")
    known = {r[0] for r in rows if r[0]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(1).to_pylist()
            n, letters, digits, symbols, dense = char_counts([t or "" for t in texts])
            cols: list[list] = [[] for _ in STATS]
            failed, kinds = [], []
            for i, t in enumerate(texts):
                s, judged = both(t, known)
                d = max(1, int(dense[i]))
                if s["n_lines"]:
                    chars = {"n_chars": float(n[i]), "letter_ratio": letters[i] / d, "digit_ratio": digits[i] / d, "symbol_ratio": symbols[i] / d}
                    s |= chars
                    judged |= chars
                kind, rules = judge(judged)
                for c, name in zip(cols, STATS, strict=True):
                    c.append(round(float(s[name]), 6))
                failed.append(rules)
                kinds.append(kind)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.float64()) for c in cols], pa.array(failed, pa.list_(pa.string())), pa.array(kinds, pa.string())], names=[key, *STATS, "failed", "kind"])

    schema = f"`{key}` bigint, {', '.join(f'{s} double' for s in STATS)}, failed array<string>, kind string"
    return docs.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(run, schema)
