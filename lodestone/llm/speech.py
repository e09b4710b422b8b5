"""Spoken words of a subtitle text, with keys that survive recognition errors and encoding damage.

``spoken`` gives the words of a text in speaking order, without cue numbers, times, markup, sound
descriptions, speaker names, adverts and repeated rolling lines.  ``word_key`` maps a word to a key in
which letters that recognition confuses fall together and letters that a wrong decoding destroys are left out;
``word_form`` keeps the letters apart, so that alike words can be told from equal ones.
"""

from __future__ import annotations

import re
from operator import gt, itemgetter

import xxhash

TIME = r"\d{1,2}:\d{2}(?::\d{2})?[.,]\d{1,3}"
#: The two times of a cue and what follows them on their line. The group is the first time.
CUE = re.compile(rf"({TIME})[ \t]*(?:-->|,)[ \t]*{TIME}(?:[ \t]+(?:align|line|position|size|region|vertical):\S+)*")
MARKUP = re.compile(r"<[^<>]{0,200}>|\{\\[^{}]{0,80}\}|&(?:amp|lt|gt|nbsp|quot|#\d+);")
SOUND = re.compile(r"\[[^\[\]]{0,120}\]|\([^()]{0,120}\)|\*[^*\r\n]{1,80}\*")
LINES = re.compile(r"\r\n|\r|\n")
ADVERT = re.compile(r"(?i:\.(?:example|com|net|org|tv|info)\b|://)")
SPEAKER = re.compile(r"(?:^|(?<=\s))[^\W\d_a-zà-öø-ÿа-яё][^\W\da-z]{1,24}(?: [^\W\d_][^\W\da-z]{0,24}){0,2}:(?=\s|$)")
NOTES = re.compile("[♪♫#]")
HEAD = re.compile(r"^\W{0,3}WEBVTT[^\r\n]{0,60}?(?=\r|\n|\s\s|$)|^(?:Kind|Language):[^\r\n]*?(?=\r|\n|\s\s|$)", re.M)
#: UTF-8 bytes that were read as a one-byte encoding.
TWICE = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: Letters that cp1252 shows where Latin-1 has control characters.
CP1252 = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
WESTERN = re.compile("[\xa8\xb8\xc0-\xff]")
_MARKS = ".,!?…:;-\"'«»¡¿()[]|"


def _decoded(m: re.Match) -> str:
    return m.group().encode("latin-1").decode("utf-8", "replace")


_LEADS = re.compile("[ÃÐÑÄÅâÂ]")


def repaired(text: str) -> str:
    """Text whose UTF-8 bytes were decoded wrongly, once or twice, is decoded rightly; other text stays."""
    for _ in range(2):
        if not _LEADS.search(text):
            return text
        if not TWICE.search(text):
            plain = text.translate(CP1252)
            if plain == text or not TWICE.search(plain):
                return text
            text = plain
        text = TWICE.sub(_decoded, text)
    return text


#: What recognition takes for what, after folding to lower case. Both sides of a pair get one key.
WIDE = {"m": "rn", "u": "ll", "h": "ll", "w": "vv", "d": "cl", "ß": "ss"}
LOOKALIKE = {"0": "o", "1": "l", "i": "l", "|": "l", "!": "l", "e": "c", "f": "t", "q": "g", "5": "s", "8": "b", "9": "g", "6": "b", "j": "l"}
#: Cyrillic letters and what stands for them, to one letter.
CYRILLIC = {"ё": "е", "й": "и", "с": "е", "a": "а", "e": "е", "o": "о", "p": "р", "c": "е", "y": "у", "x": "х", "k": "к", "m": "м", "t": "т", "h": "н", "b": "в", "0": "о", "3": "з", "6": "б"}
_KEY = str.maketrans({**{k: "".join(LOOKALIKE.get(c, c) for c in v) for k, v in WIDE.items()}, **LOOKALIKE})
_CYR = str.maketrans(CYRILLIC)
_CYRILLIC = re.compile("[а-яё]")
_LETTERS = re.compile("[a-z]")


def _lower(word: str) -> str:
    """The word in lower case; one whose letters are Cyrillic ones read as Western ones is read rightly."""
    western = len(WESTERN.findall(word))
    if western and (western > 2 or western == len(word.strip(_MARKS))) and western > len(_LETTERS.findall(word.lower())):
        word = word.encode("latin-1", "ignore").decode("cp1251", "ignore")
    return word.lower()


def word_key(word: str) -> str:
    """The key of one word; empty if nothing of it is a letter that survives damage. Digits alone stay as they are."""
    if len(alone := word.strip(_MARKS)) == 1 and not alone.isascii():
        return ""  # one letter that a wrong decoding turns into another or destroys
    w = _lower(word)
    if _CYRILLIC.search(w):
        return re.sub(r"[^0-9а-я]", "", w.translate(_CYR))
    w = w.strip(_MARKS)
    if w.isdigit():
        return w
    return re.sub(r"[^a-z]", "", re.sub(r"[^a-z0-9|!ß]", "", w).translate(_KEY)).replace("ss", "")


#: What no one writes: a digit among letters, a capital behind a small letter.
_MISREAD = re.compile(r"[^\W\d_]\d|\d[^\W\d_]|[a-zà-öø-ÿа-яё][A-ZÀ-ÖØ-ÞА-ЯЁ]")


def word_form(word: str) -> str:
    """The word without case, punctuation and letters that a wrong decoding destroys, otherwise as it stands; empty if it is misread for certain."""
    if _MISREAD.search(word):
        return ""
    w = _lower(word)
    return re.sub("[^0-9а-я]", "", w.replace("ё", "е")) if _CYRILLIC.search(w) else re.sub("[^0-9a-z]", "", w)


class Keys(dict):
    """A 63-bit number for the key of each word, 0 for none, worked out once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        key = word_key(word)
        n = self[word] = xxhash.xxh3_64_intdigest(key) >> 1 if key else 0
        return n


_MEMO = Keys()
#: Text between notes, or between what a wrong decoding has made of them: a sound description or a song.
_BETWEEN_NOTES = re.compile(r"(?:[♪♫]|(?<!\S)�(?=\s))([^♪♫�]{0,60})(?:[♪♫]|(?<=\s)�(?!\S)|$)", re.S)


def plain(text: str) -> str:
    """Text without markup and sound descriptions, in the right encoding."""
    text = repaired(text)
    if "<" in text or "{" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    return SOUND.sub(" ", text)


def readings(text: str) -> list[str]:
    """The text as it may be read: what stands between notes is sung, or describes a sound and is left out."""
    text = plain(text)
    if "♪" not in text and "♫" not in text and "�" not in text:
        return [text]
    bare = lambda t: t.replace("♪", " ").replace("♫", " ")
    song = bare(_BETWEEN_NOTES.sub(lambda m: " " + m.group(1) + m.group()[-1:], text))
    quiet = bare(_BETWEEN_NOTES.sub(" ", text))
    return [song] if song.split() == quiet.split() else [song, quiet]


def _unnumbered(body: str) -> str:
    """A body without the number of the next cue, which stands alone on its last line, or last where there are no lines."""
    head, _, tail = body.rpartition("\n") if "\n" in body else body.rpartition(" ")
    return head if tail.strip().isdigit() else body


def cues(text: str) -> tuple[list[str], list[str]]:
    """Start times and bodies of the cues in the order of the file. Text before the first time has an empty start."""
    if "WEBVTT" in text or "Kind:" in text or "Language:" in text:
        text = HEAD.sub(" ", text)
    parts = CUE.split(text)
    return ["", *parts[1::2]], [*(_unnumbered(b.rstrip()) for b in parts[0:-1:2]), parts[-1]]


def _at(start: str) -> tuple[int, ...]:
    t = [int(x) for x in re.split("[:.,]", start)] if start else []
    return tuple([0] * (4 - len(t)) + t)


def _speech(bodies: list[str], memo: Keys) -> tuple[list[str], list[int]]:
    """The words that have a key, and their keys' numbers, cue by cue, without what a cue repeats of the one before."""
    out: list[str] = []
    numbers: list[int] = []
    before: tuple[str, list[int]] = ("", [])
    new: list[int] = []
    carry = ""
    whole = "\n".join(bodies)
    adverts = ADVERT.search(whole) is not None
    hyphens = _HYPHEN.search(whole) is not None
    get = memo.__getitem__
    for body in bodies:
        if ":" in body:
            body = SPEAKER.sub(" ", body)
        words = body.split()
        if hyphens and words:
            words, carry = _joined(words, carry)
        keys = list(map(get, words))
        if 0 in keys:
            words = [w for w, k in zip(words, keys) if k]
            keys = [k for k in keys if k]
        if not keys:
            continue
        n, cut = len(new), 0
        if n and keys[:n] == new:
            cut = n
        elif keys[0] in before[1]:
            cut = _again(before, (body, keys), memo)
        before = (body, keys)
        if cut == len(keys):
            continue
        new = keys[cut:]
        if adverts and ADVERT.search(body):
            continue
        out += words[cut:]
        numbers += new
    return out, numbers


def _again(before: tuple[str, list[int]], now: tuple[str, list[int]], memo: Keys) -> int:
    """How many words of a cue are the end of the one before: whole lines, or three words and more."""
    last, this = ([t for x in body.split("\n") if (t := [k for k in map(memo.__getitem__, x.split()) if k])] for body, _ in (before, now))
    lines = next((k for k in range(min(len(last), len(this)), 0, -1) if last[-k:] == this[:k]), 0)
    if lines:
        return min(sum(map(len, this[:lines])), len(now[1]))
    return next((k for k in range(min(len(before[1]), len(now[1])), 2, -1) if before[1][-k:] == now[1][:k]), 0)


_HYPHEN = re.compile(r"-(?<=\w-)\s")


def _joined(words: list[str], carry: str) -> tuple[list[str], str]:
    """Words broken by a hyphen at the end of a line put together; the part of one that the next cue goes on with."""
    if carry:
        words = [carry + words[0], *words[1:]]
    out: list[str] = []
    for w in words:
        if out and out[-1][-1] == "-" and len(out[-1]) > 2:
            out[-1] = out[-1][:-1] + w
        else:
            out.append(w)
    if out[-1][-1] == "-" and len(out[-1]) > 2:
        return out[:-1], out[-1][:-1]
    return out, ""


def spoken(text: str, memo: Keys | None = None) -> list[tuple[list[str], list[int]]]:
    """Words spoken that have a key, and its numbers, for each reading in the order of the file and, where that differs, of time as well.

    What stands before a colon in capitals is taken for a speaker's name; who looks for a text in which it is not has
    to look for it without those words.
    """
    memo = _MEMO if memo is None else memo
    out = []
    for reading in readings(text):
        starts, bodies = cues(reading)
        out.append(_speech(bodies, memo))
        if any(map(gt, starts, starts[1:])):
            times = [_at(t) for t in starts]
            if any(map(gt, times, times[1:])):
                out.append(_speech([b for _, b in sorted(zip(times, bodies), key=itemgetter(0))], memo))
    return out
