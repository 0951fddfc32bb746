"""Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980), in the variant
with the common extensions used by the reference's cleaner:

* words of one or two letters are left alone;
* a few irregular forms map directly (sky/skies, dying, lying, tying, news, innings,
  outings, cannings, howe, proceed, exceed, succeed);
* step 1a: a four-letter word in -ies becomes -ie (ties -> tie);
* step 1b: -ied becomes -ie in four-letter words, else -i;
* step 1c: y -> i only after a consonant that is not the word's first letter;
* step 2: -alli is reduced first (and step 2 re-run); bli -> ble, logi -> log,
  fulli -> ful, lessli -> less;
* a two-letter stem vowel+consonant counts as ending consonant-vowel-consonant.

Pure Python on one token; callers apply it to distinct tokens (see ``operators.stem``).
"""

from __future__ import annotations

_VOWELS = frozenset("aeiou")

# Irregular forms mapped directly.
_IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def _cons(w: str, i: int) -> bool:
    """Is w[i] a consonant? y is a consonant at the start or after a vowel."""
    c = w[i]
    if c in _VOWELS:
        return False
    if c == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    """m in [C](VC)^m[V]."""
    m, prev_vowel = 0, False
    for i in range(len(stem)):
        v = not _cons(stem, i)
        if prev_vowel and not v:
            m += 1
        prev_vowel = v
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) >= 3:
        return (_cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1)
                and w[-1] not in "wxy")
    return len(w) == 2 and not _cons(w, 0) and _cons(w, 1)


def _first_rule(word: str, rules) -> str:
    """Apply the rule whose suffix matches first; if its condition fails, leave the word."""
    for suffix, repl, cond in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + repl if cond is None or cond(stem) else word
    return word


def _m_pos(stem):
    return _measure(stem) > 0


def _m_gt1(stem):
    return _measure(stem) > 1


_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"), ("lessli", "less"), ("logi", "log"),
]
_STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
          "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _step1a(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-3] + "ie"
    return _first_rule(w, [("sses", "ss", None), ("ies", "i", None), ("ss", "ss", None), ("s", "", None)])


def _step1b(w: str) -> str:
    if w.endswith("ied"):
        return w[:-3] + ("ie" if len(w) == 4 else "i")
    if w.endswith("eed"):
        stem = w[:-3]
        return stem + "ee" if _measure(stem) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
            s = w[: -len(suffix)]
            break
    else:
        return w
    if s.endswith(("at", "bl", "iz")):
        return s + "e"
    if _double_cons(s):
        return s[:-1] if s[-1] not in "lsz" else s
    if _measure(s) == 1 and _cvc(s):
        return s + "e"
    return s


def _step1c(w: str) -> str:
    if w.endswith("y") and len(w) > 2 and _cons(w, len(w) - 2):
        return w[:-1] + "i"
    return w


def _step2(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _step2(w[:-4] + "al")
    return _first_rule(w, [(s, r, _m_pos) for s, r in _STEP2])


def _step3(w: str) -> str:
    return _first_rule(w, [(s, r, _m_pos) for s, r in _STEP3])


def _step4(w: str) -> str:
    rules = []
    for s in _STEP4:
        if s == "ion":
            rules.append((s, "", lambda stem: _measure(stem) > 1 and stem[-1:] in ("s", "t")))
        else:
            rules.append((s, "", _m_gt1))
    return _first_rule(w, rules)


def _step5(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stem(word: str) -> str:
    """Stem one lower-case word."""
    if word is None:
        return None
    w = word.lower()
    if w in _IRREGULAR:
        return _IRREGULAR[w]
    if len(w) <= 2:
        return w
    for step in (_step1a, _step1b, _step1c, _step2, _step3, _step4, _step5):
        w = step(w)
    return w
