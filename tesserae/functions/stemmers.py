"""Stemmers as plain functions of one term; analysis calls them over batches of distinct terms."""

from __future__ import annotations

from collections.abc import Callable

VOWELS = set("aeiou")


def _consonants(w: str) -> list[bool]:
    """For each letter, whether it is a consonant: not a vowel, and not a y after a consonant."""
    out: list[bool] = []
    for i, c in enumerate(w):
        out.append(c not in VOWELS and not (c == "y" and i > 0 and out[i - 1]))
    return out


def _measure(w: str) -> int:
    """Changes from vowel to consonant."""
    c = _consonants(w)
    return sum(1 for a, b in zip(c, c[1:]) if not a and b)


def _has_vowel(w: str) -> bool:
    return not all(_consonants(w))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1]


def _short(w: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    if len(w) < 3 or w[-1] in "wxy":
        return False
    c = _consonants(w)
    return c[-1] and not c[-2] and c[-3]


# Suffixes and what replaces them, by step of the published algorithm.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def porter(w: str) -> str:
    """M. F. Porter, An algorithm for suffix stripping (1980), with the author's later departures."""
    if len(w) < 3:
        return w
    # 1a: plurals
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # 1b: past tenses
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and _has_vowel(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w):
                if w[-1] not in "lsz":
                    w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    # 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # 2 and 3: double suffixes
    for table in (_STEP2, _STEP3):
        if (s := _longest(w, table)) and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    # 4: single suffixes
    if s := _longest(w, _STEP4):
        head = w[: -len(s)]
        if _measure(head) > 1 and (s != "ion" or head.endswith(("s", "t"))):
            w = head
    # 5: final e and double l
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


# The published light stemmer's affixes.
_ARABIC_PREFIXES = ("وال", "بال", "كال", "فال", "ال", "لل", "و")
_ARABIC_SUFFIXES = ("ها", "ان", "ات", "ون", "ين", "يه", "ية", "ه", "ة", "ي")


def arabic(w: str) -> str:
    """Light stemming: a definite article or conjunction before, then each listed ending behind, while enough is left."""
    for p in _ARABIC_PREFIXES:
        if w.startswith(p) and len(w) >= (4 if len(p) == 1 else len(p) + 2):
            w = w[len(p) :]
            break
    for s in _ARABIC_SUFFIXES:
        if w.endswith(s) and len(w) >= len(s) + 2:
            w = w[: -len(s)]
    return w


def _region(w: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first consonant behind a vowel begins, from ``start`` on."""
    for i in range(start + 1, len(w)):
        if w[i] not in vowels and w[i - 1] in vowels:
            return i + 1
    return len(w)


def _ends(w: str, suffixes, at: int) -> str:
    """The longest suffix that lies wholly behind ``at``."""
    return max((s for s in suffixes if w.endswith(s) and len(w) - len(s) >= at), key=len, default="")


def german(w: str) -> str:
    """The published German algorithm of the Snowball family."""
    vowels = "aeiouyäöü"
    w = w.replace("ß", "ss")
    w = "".join(c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in vowels and w[i + 1] in vowels else c for i, c in enumerate(w))
    r1 = _region(w, vowels)
    r2 = _region(w, vowels, r1)
    r1 = max(r1, 3)
    s = max((x for x in ("em", "ern", "er", "e", "en", "es", "s") if w.endswith(x)), key=len, default="")
    if s and len(w) - len(s) >= r1 and (s != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = max((x for x in ("en", "er", "est", "st") if w.endswith(x)), key=len, default="")
    if s and len(w) - len(s) >= r1 and (s != "st" or len(w) >= 6 and w[-3] in "bdfghklmnt"):
        w = w[: -len(s)]
    s = max((x for x in ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit") if w.endswith(x)), key=len, default="")
    if s and len(w) - len(s) >= r2:
        head = w[: -len(s)]
        if s in ("end", "ung"):
            w = head
            if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                w = w[:-2]
        elif s in ("ig", "ik", "isch"):
            if not head.endswith("e"):
                w = head
        elif s in ("lich", "heit"):
            w = head
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = head
            if (x := _ends(w, ("lich", "ig"), r2)):
                w = w[: -len(x)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


def _scandinavian(main: tuple[str, ...], s_after: str, pairs: tuple[str, ...], last: tuple[str, ...], vowels: str) -> Callable[[str], str]:
    """The common shape of the published Swedish and Norwegian algorithms."""
    def stem(w: str) -> str:
        r1 = max(_region(w, vowels), 3)
        if x := _ends(w, (*main, "s"), r1):
            if x != "s":
                w = w[: -len(x)]
            elif len(w) > 1 and w[-2] in s_after:
                w = w[:-1]
        if _ends(w, pairs, r1):
            w = w[:-1]
        if x := _ends(w, last, r1):
            w = w[: -len(x)]
        return w

    return stem


# The endings of the published Swedish algorithm.
_SWEDISH = tuple("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split())
_swedish_steps = _scandinavian(_SWEDISH, "bcdfghjklmnoprtvy", ("dd", "gd", "nn", "dt", "gt", "kt", "tt"), ("lig", "els", "ig"), "aeiouyäåö")


def swedish(w: str) -> str:
    out = _swedish_steps(w)
    r1 = max(_region(w, "aeiouyäåö"), 3)
    return out[:-1] if _ends(out, ("löst", "fullt"), r1) else out


# The endings of the published Norwegian and Danish algorithms.
_NORWEGIAN = tuple("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split())
_DANISH = tuple("hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split())


def norwegian(w: str) -> str:
    vowels = "aeiouyæåø"
    r1 = max(_region(w, vowels), 3)
    x = _ends(w, (*_NORWEGIAN, "s", "erte", "ert"), r1)
    if x in ("erte", "ert"):
        w = w[: -len(x)] + "er"
    elif x == "s":
        if w[-2:-1] in tuple("bcdfghjlmnoprtvyz") or w[-2:-1] == "k" and w[-3:-2] not in tuple(vowels):
            w = w[:-1]
    elif x:
        w = w[: -len(x)]
    if _ends(w, ("dt", "vt"), r1):
        w = w[:-1]
    if x := _ends(w, ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov"), r1):
        w = w[: -len(x)]
    return w


def danish(w: str) -> str:
    vowels = "aeiouyæåø"
    r1 = max(_region(w, vowels), 3)

    def pair(w: str) -> str:
        return w[:-1] if _ends(w, ("gd", "dt", "gt", "kt"), r1) else w

    x = _ends(w, (*_DANISH, "s"), r1)
    if x == "s":
        if w[-2:-1] in tuple("abcdfghjklmnoprtvyzå"):
            w = w[:-1]
    elif x:
        w = w[: -len(x)]
    w = pair(w)
    if w.endswith("igst"):
        w = w[:-2]
    if x := _ends(w, ("ig", "lig", "elig", "els"), r1):
        w = pair(w[: -len(x)])
    elif _ends(w, ("løst",), r1):
        w = w[:-1]
    if len(w) > r1 and w[-1] not in vowels and w[-1] == w[-2:-1]:
        w = w[:-1]
    return w


def _after_vowel(w: str, vowels: str) -> int:
    """The Romance region: behind the next vowel if the second letter is a consonant, behind the next consonant if the first two are vowels, else behind the third letter."""
    if len(w) < 3:
        return len(w)
    if w[1] not in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] in vowels), len(w))
    if w[0] in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in vowels), len(w))
    return 3


def _without(w: str, suffixes, at: int) -> str:
    """w without the longest of the suffixes that lies behind ``at``, if any does."""
    s = _ends(w, suffixes, at)
    return w[: -len(s)] if s else w


def _longest_of(w: str, *tables) -> tuple[str, int]:
    """The longest suffix of all tables that w ends with, and its table; '' and -1 without any."""
    return max(((s, k) for k, t in enumerate(tables) for s in t if w.endswith(s)), key=lambda x: len(x[0]), default=("", -1))


# Words that the published English algorithm treats apart, and its suffixes by step.
_EN_WHOLE = dict(zip("skis skies dying lying tying idly gently ugly early only singly".split(), "ski sky die lie tie idl gentl ugli earli onli singl".split())) | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_EN_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_EN_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
_EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def english(w: str) -> str:
    """The published second English algorithm of the Snowball family."""
    vowels = "aeiouy"
    if len(w) < 3 or w in _EN_WHOLE:
        return _EN_WHOLE.get(w, w)
    w = w.removeprefix("'")
    w = "".join("Y" if c == "y" and (not i or w[i - 1] in vowels) else c for i, c in enumerate(w))
    r1 = next((len(x) for x in ("gener", "commun", "arsen") if w.startswith(x)), None) or _region(w, vowels)
    r2 = _region(w, vowels, r1)

    def short_syllable(x: str) -> bool:
        if len(x) == 2:
            return x[0] in vowels and x[1] not in vowels
        return len(x) > 2 and x[-3] not in vowels and x[-2] in vowels and x[-1] not in vowels + "wxY"

    def has_vowel(x: str) -> bool:
        return any(c in vowels for c in x)

    w = w[: len(w) - len(_ends(w, ("'s'", "'s", "'"), 0))]
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[: -2 if len(w) > 4 else -1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and has_vowel(w[:-2]):
        w = w[:-1]
    if w in _EN_PLURAL:
        return w
    s = _ends(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"), 0)
    if s.startswith("eed"):
        w = w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
    elif s and has_vowel(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(tuple(c + c for c in "bdfgmnprt")):
            w = w[:-1]
        elif len(w) <= r1 and short_syllable(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in vowels:
        w = w[:-1] + "i"
    s = _longest(w, _EN_STEP2) or ""
    head = w[: len(w) - len(s)]
    if s and len(head) >= r1 and (s != "ogi" or head.endswith("l")) and (s != "li" or head[-1:] in tuple("cdeghkmnrt")):
        w = head + _EN_STEP2[s]
    s = _longest(w, _EN_STEP3) or ""
    head = w[: len(w) - len(s)]
    if s and len(head) >= (r2 if s == "ative" else r1):
        w = head + _EN_STEP3[s]
    s = _longest(w, _EN_STEP4) or ""
    head = w[: len(w) - len(s)]
    if s and len(head) >= r2 and (s != "ion" or head.endswith(("s", "t"))):
        w = head
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not short_syllable(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# The endings of the published Italian algorithm.
_IT_PRONOUNS = "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split()
_IT_PLAIN = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split()
_IT_VERBS = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo "
    "Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
).split()


def italian(w: str) -> str:
    """The published Italian algorithm of the Snowball family."""
    vowels = "aeiouàèìòù"
    w = w.translate(str.maketrans("áéíóú", "àèìòù"))
    w = "".join("U" if c == "u" and w[i - 1 : i] == "q" else c.upper() if c in "ui" and 0 < i < len(w) - 1 and w[i - 1] in vowels and w[i + 1] in vowels else c for i, c in enumerate(w))
    rv = _after_vowel(w, vowels)
    r1 = _region(w, vowels)
    r2 = _region(w, vowels, r1)
    if p := _ends(w, _IT_PRONOUNS, rv):
        head = w[: -len(p)]
        if _ends(head, ("ando", "endo"), rv):
            w = head
        elif _ends(head, ("ar", "er", "ir"), rv):
            w = head + "e"
    start = w
    s, k = _longest_of(w, _IT_PLAIN, "azione azioni atore atori".split(), ("logia", "logie"), "uzione uzioni usione usioni".split(), ("enza", "enze"), "amento amenti imento imenti".split(), ("amente",), ("ità",), "ivo ivi iva ive".split())
    head = w[: len(w) - len(s)]
    if k == 5:
        w = head if len(head) >= rv else w
    elif k == 6:
        if len(head) >= r1:
            w = _without(head[:-2], ("at",), r2) if head.endswith("iv") and len(head) - 2 >= r2 else _without(head, ("os", "ic", "abil"), r2)
    elif k >= 0 and len(head) >= r2:
        w = head + {2: "log", 3: "u", 4: "ente"}.get(k, "")
        w = _without(w, {1: ("ic",), 7: ("abil", "ic", "iv")}.get(k, ()), r2)
        if k == 8 and _ends(w, ("at",), r2):
            w = _without(w[:-2], ("ic",), r2)
    if w == start:
        w = _without(w, _IT_VERBS, rv)
    if _ends(w, tuple("aeioàèìò"), rv):
        w = w[:-1]
        if _ends(w, ("i",), rv):
            w = w[:-1]
    if _ends(w, ("ch", "gh"), rv):
        w = w[:-1]
    return w.lower()


_UMLAUTS = str.maketrans("äëïöüáéíóú", "aeiouaeiou")


def dutch(w: str) -> str:
    """The published Dutch algorithm of the Snowball family."""
    vowels = "aeiouyè"
    w = w.translate(_UMLAUTS)
    w = "".join("Y" if c == "y" and (not i or w[i - 1] in vowels) else "I" if c == "i" and 0 < i < len(w) - 1 and w[i - 1] in vowels and w[i + 1] in vowels else c for i, c in enumerate(w))
    r1 = _region(w, vowels)
    r2 = _region(w, vowels, r1)
    r1 = max(r1, 3)
    single = lambda x: x[:-1] if x.endswith(("kk", "dd", "tt", "nn", "mm", "ff")) else x

    def en(x: str, suffix: str) -> str:
        head = x[: -len(suffix)]
        return single(head) if len(head) >= r1 and head and head[-1] not in vowels and not head.endswith("gem") else x

    def last_e(x: str) -> str:
        return single(x[:-1]) if x.endswith("e") and len(x) > r1 and len(x) > 1 and x[-2] not in vowels else x

    s, _ = _longest_of(w, ("heden", "ene", "en", "se", "s"))
    if s == "heden":
        w = w[:-5] + "heid" if len(w) - 5 >= r1 else w
    elif s in ("en", "ene"):
        w = en(w, s)
    elif s and len(w) - len(s) >= r1 and w[: -len(s)] and w[: -len(s)][-1] not in vowels + "j":
        w = w[: -len(s)]
    before = w
    w = last_e(w)
    lost_e = w != before
    if w.endswith("heid") and len(w) - 4 >= r2 and not w.endswith("cheid"):
        w = w[:-4]
        if w.endswith("en"):
            w = en(w, "en")
    s, _ = _longest_of(w, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if s and len(w) - len(s) >= r2:
        head = w[: -len(s)]
        if s in ("end", "ing"):
            w = head[:-2] if head.endswith("ig") and len(head) - 2 >= r2 and not head.endswith("eig") else single(head)
        elif s == "ig":
            w = w if head.endswith("e") else head
        elif s == "lijk":
            w = last_e(head)
        elif s == "baar" or lost_e:
            w = head
    if len(w) > 3 and w[-4] not in vowels and w[-3] == w[-2] and w[-2] in "aeou" and w[-1] not in vowels + "I":
        w = w[:-2] + w[-1]
    return w.lower()


# The endings of the published Portuguese algorithm.
_PT_PLAIN = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split()
_PT_VERBS = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir "
    "as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis "
    "ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
).split()


def portuguese(w: str) -> str:
    """The published Portuguese algorithm of the Snowball family."""
    vowels = "aeiouáéíóúâêô"
    w = w.replace("ã", "a~").replace("õ", "o~")
    rv = _after_vowel(w, vowels)
    r1 = _region(w, vowels)
    r2 = _region(w, vowels, r1)
    start = w
    s, k = _longest_of(w, _PT_PLAIN, ("logia", "logias"), ("uça~o", "uço~es"), ("ência", "ências"), ("amente",), ("mente",), ("idade", "idades"), ("iva", "ivo", "ivas", "ivos"), ("ira", "iras"))
    head = w[: len(w) - len(s)]
    if k == 4 and len(head) >= r1:
        w = head
        if w.endswith("iv") and len(w) - 2 >= r2:
            w = _without(w[:-2], ("at",), r2)
        else:
            w = _without(w, ("os", "ic", "ad"), r2)
    elif k == 8:
        w = head + "ir" if len(head) >= rv and head.endswith("e") else w
    elif k >= 0 and k != 4 and len(head) >= r2:
        w = head + ("", "log", "u", "ente", "", "", "", "")[k]
        w = _without(w, {5: ("ante", "avel", "ível"), 6: ("abil", "ic", "iv"), 7: ("at",)}.get(k, ()), r2)
    if w == start:
        w = _without(w, _PT_VERBS, rv)
    if w != start:
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    else:
        w = _without(w, ("os", "a", "i", "o", "á", "í", "ó"), rv)
    if _ends(w, ("e", "é", "ê"), rv):
        w = w[:-1]
        if w.endswith(("gu", "ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


def brazilian(w: str) -> str:
    """Portuguese endings from words without their accents' marks."""
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", portuguese(w.lower())) if not unicodedata.combining(c))


# The endings of the published French algorithm.
_FR_I = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def french(w: str) -> str:
    """The published French algorithm of the Snowball family."""
    vowels = "aeiouyâàëéêèïîôûù"
    raised = []
    for i, c in enumerate(w):
        before, after = w[i - 1 : i] if i else "", w[i + 1 : i + 2]
        between = bool(before) and before in vowels and bool(after) and after in vowels
        beside = bool(before) and before in vowels or bool(after) and after in vowels
        raised.append(c.upper() if c in "ui" and between or c == "y" and beside or c == "u" and before == "q" else c)
    w = "".join(raised)
    if w[:3] in ("par", "col", "tap") or len(w) > 1 and w[0] in vowels and w[1] in vowels:
        rv = min(3, len(w))
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in vowels), len(w))
    r1 = _region(w, vowels)
    r2 = _region(w, vowels, r1)
    start, again = w, False
    tables = (
        "ance iqUe isme able iste eux ances iqUes ismes ables istes".split(),
        "atrice ateur ation atrices ateurs ations".split(),
        ("logie", "logies"),
        "usion ution usions utions".split(),
        ("ence", "ences"),
        ("ement", "ements"),
        ("ité", "ités"),
        "if ive ifs ives".split(),
        ("eaux",),
        ("aux",),
        ("euse", "euses"),
        ("issement", "issements"),
        ("amment",),
        ("emment",),
        ("ment", "ments"),
    )
    s, k = _longest_of(w, *tables)
    head = w[: len(w) - len(s)]
    n = len(head)

    def or_else(x: str, suffix: str, instead: str) -> str:  # the suffix goes in R2, elsewhere it is replaced
        return x if not x.endswith(suffix) else x[: -len(suffix)] + ("" if len(x) - len(suffix) >= r2 else instead)

    if k == 0 and n >= r2:
        w = head
    elif k == 1 and n >= r2:
        w = or_else(head, "ic", "iqU")
    elif k in (2, 3, 4) and n >= r2:
        w = head + ("log", "u", "ent")[k - 2]
    elif k == 5 and n >= rv:
        w = head
        if w.endswith("iv") and len(w) - 2 >= r2:
            w = _without(w[:-2], ("at",), r2)
        elif w.endswith("eus"):
            w = w[:-3] if len(w) - 3 >= r2 else w[:-1] + "x" if len(w) - 3 >= r1 else w
        elif _ends(w, ("abl", "iqU"), r2):
            w = w[:-3]
        elif _ends(w, ("ièr", "Ièr"), rv):
            w = w[:-3] + "i"
    elif k == 6 and n >= r2:
        w = or_else(or_else(head, "abil", "abl"), "ic", "iqU")
        w = _without(w, ("iv",), r2)
    elif k == 7 and n >= r2:
        w = or_else(head[:-2], "ic", "iqU") if head.endswith("at") and n - 2 >= r2 else head
    elif k == 8:
        w = head + "eau"
    elif k == 9 and n >= r1:
        w = head + "al"
    elif k == 10:
        w = head if n >= r2 else head + "eux" if n >= r1 else w
    elif k == 11 and n >= r1 and head and head[-1] not in vowels:
        w = head
    elif k in (12, 13) and n >= rv:
        w, again = head + ("ant", "ent")[k - 12], True
    elif k == 14 and n - 1 >= rv and head and head[-1] in vowels:
        w, again = head, True
    changed = w != start
    if not changed or again:
        verb = _ends(w, _FR_I, rv)
        if verb and len(w) - len(verb) - 1 >= rv and w[: -len(verb)][-1] not in vowels:
            w, changed = w[: -len(verb)], True
        else:
            verb, kind = max(((_ends(w, t, rv), k) for k, t in enumerate((("ions",), _FR_E, _FR_A))), key=lambda x: len(x[0]))
            if verb and (kind or len(w) - len(verb) >= r2):
                w, changed = w[: -len(verb)], True
                if kind == 2 and w.endswith("e") and len(w) - 1 >= rv:
                    w = w[:-1]
    if changed:
        w = w[:-1] + {"Y": "i", "ç": "c"}.get(w[-1:], w[-1:])
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        s, k = max(((_ends(w, t, rv), k) for k, t in enumerate((("ion",), ("ier", "ière", "Ier", "Ière"), ("e",), ("ë",)))), key=lambda x: len(x[0]))
        if k == 0 and s and len(w) - 3 >= r2 and len(w) - 4 >= rv and w[-4] in "st":
            w = w[:-3]
        elif k == 1:
            w = w[: -len(s)] + "i"
        elif k == 2 or k == 3 and w.endswith("guë"):
            w = w[:-1]
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    tail = len(w) - next((i for i, c in enumerate(reversed(w)) if c in vowels), len(w))
    if 0 < tail < len(w) and w[tail - 1] in "éè":
        w = w[: tail - 1] + "e" + w[tail:]
    return w.lower()


# The endings of the published Spanish algorithm.
_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_ES_PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_ES_TION = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
_ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_ES_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos "
    "amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
_ACUTE = str.maketrans("áéíóú", "aeiou")


def spanish(w: str) -> str:
    """The published Spanish algorithm of the Snowball family."""
    vowels = "aeiouáéíóúü"
    rv = _after_vowel(w, vowels)
    r1 = _region(w, vowels)
    r2 = _region(w, vowels, r1)
    pronoun = _ends(w, _ES_PRONOUNS, rv)
    if pronoun:
        head = w[: -len(pronoun)]
        if x := _ends(head, ("iéndo", "ándo", "ár", "ér", "ír"), rv):
            w = head[: -len(x)] + x.translate(_ACUTE)
        elif _ends(head, ("ando", "iendo", "ar", "er", "ir"), rv) or head.endswith("uyendo") and len(head) - 5 >= rv:
            w = head
    start = w
    s, k = _longest_of(w, _ES_PLAIN, _ES_TION, ("logía", "logías"), ("ución", "uciones"), ("encia", "encias"), ("amente",), ("mente",), ("idad", "idades"), ("iva", "ivo", "ivas", "ivos"))
    head = w[: len(w) - len(s)]
    if k == 5 and len(head) >= r1:
        w = _without(head[:-2], ("at",), r2) if head.endswith("iv") and len(head) - 2 >= r2 else _without(head, ("os", "ic", "ad"), r2)
    elif k >= 0 and k != 5 and len(head) >= r2:
        w = head + {2: "log", 3: "u", 4: "ente"}.get(k, "")
        w = _without(w, {1: ("ic",), 6: ("ante", "able", "ible"), 7: ("abil", "ic", "iv"), 8: ("at",)}.get(k, ()), r2)
    if w == start:
        y = _ends(w, _ES_Y, rv)
        if y and w[: -len(y)].endswith("u"):
            w = w[: -len(y)]
        else:
            s = _ends(w, (*_ES_VERBS, "en", "es", "éis", "emos"), rv)
            if s:
                w = w[: -len(s)]
                if s in ("en", "es", "éis", "emos") and w.endswith("gu"):
                    w = w[:-1]
    if s := _ends(w, ("os", "a", "o", "á", "í", "ó"), rv):
        w = w[: -len(s)]
    elif _ends(w, ("e", "é"), rv):
        w = w[:-1]
        if w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_ACUTE)


# The endings of the published Russian algorithm; those of the first kind stand behind а or я.
_RU_GERUND = "в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split()
_RU_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_RU_PARTICIPLE = "ем нн вш ющ щ".split(), "ивш ывш ующ".split()
_RU_VERB = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
_RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def russian(w: str) -> str:
    """The published Russian algorithm of the Snowball family."""
    vowels = "аеиоуыэюя"
    w = w.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in vowels), len(w))
    r2 = _region(w, vowels, _region(w, vowels))

    def two_kinds(x: str, kinds) -> str:
        behind, free = kinds
        best = max((s for s in (*behind, *free) if x.endswith(s) and len(x) - len(s) >= rv and (s in free or x[: -len(s)][rv:].endswith(("а", "я")))), key=len, default="")
        return x[: -len(best)] if best else x

    x = two_kinds(w, _RU_GERUND)
    if x == w:
        w = _without(w, ("ся", "сь"), rv)
        x = _without(w, _RU_ADJECTIVE, rv)
        if x != w:
            x = two_kinds(x, _RU_PARTICIPLE)
        else:
            x = two_kinds(w, _RU_VERB)
            if x == w:
                x = _without(w, _RU_NOUN, rv)
    w = _without(x, ("и",), rv)
    w = _without(w, ("ость", "ост"), max(r2, rv))
    x = _without(w, ("ейше", "ейш"), rv)
    if x.endswith("нн") and len(x) - 2 >= rv:
        return x[:-1]
    return x if x != w else _without(w, ("ь",), rv)


NAMES: dict[str, Callable[[str], str]] = {"porter": porter, "arabic": arabic, "german": german, "swedish": swedish, "norwegian": norwegian, "danish": danish, "dutch": dutch, "portuguese": portuguese, "brazilian": brazilian, "french": french, "spanish": spanish, "russian": russian, "english": english, "italian": italian}


def by_name(name: str) -> Callable[[str], str]:
    found = NAMES.get(name.lower())
    if found is None:
        raise ValueError(f"no stemmer named {name}; there are {sorted(NAMES)}")
    return found
