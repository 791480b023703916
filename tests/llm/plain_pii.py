"""The surrogates of tidewheel.llm.pii in plain Python, text by text."""

import datetime
import hashlib

import regex

from tidewheel.llm import pii as spark_side


class pii:  # noqa: N801  the constants, with digits and blanks as Java's patterns understand them
    pass


for _name, _value in vars(spark_side).items():
    if _name.isupper():
        plain = lambda v: v.replace(r"[^\s", r"[^ \t\n\x0b\f\r").replace(r"\s", r"[ \t\n\x0b\f\r]").replace(r"\d", "[0-9]") if isinstance(v, str) else v
        setattr(pii, _name, {k: plain(v) for k, v in _value.items()} if isinstance(_value, dict) else plain(_value))


FLAGS = regex.V1
START = datetime.date(1900, 1, 1)


def sha(*parts):
    return hashlib.sha256("\n".join(map(str, parts)).encode()).hexdigest()


def stream(seed, size):
    out = ""
    while len(out) < size:
        out += sha(seed, len(out) // 64)
    return out[:size]


def shifted(chars, digits):
    out = []
    for i, c in enumerate(chars):
        a = next((a for a in pii.ALPHABETS if c in a), None)
        out.append(a[(a.index(c) + int(digits[4 * i : 4 * i + 4], 16)) % len(a)] if a else c)
    return out


def feistel(text, seed):
    a, b = list(text[: len(text) // 2]), list(text[len(text) // 2 :])
    for r in range(4):
        mine, other = (a, b) if r % 2 == 0 else (b, a)
        moved = shifted(mine, stream("\n".join([seed, str(r), "".join(other)]), len(mine) * 4))
        a, b = (moved, b) if r % 2 == 0 else (a, moved)
    return "".join(a + b)


def luhn(digits):
    return -sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def iban_check(bank, country):
    return 98 - int("".join(str(int(c, 36)) for c in bank + country + "00")) % 97


def kind_of(m):
    for kind, lead in pii.LEADS.items():
        if regex.match(lead, m, FLAGS):
            return kind
    tests = [
        ("email", "@" in m), ("cloud_key", regex.fullmatch("AKIA[0-9A-Z]{16}", m)), ("name", regex.match(pii.TITLE, m, FLAGS) or not regex.search("[0-9]", m)),
        ("ip", regex.fullmatch(rf"(?:{pii.OCTET}\.){{3}}{pii.OCTET}", m, FLAGS)), ("ssn", regex.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", m)), ("iban", regex.match("[A-Z]{2}", m)),
        ("card", regex.fullmatch("(?:[0-9][ -]?){12,18}[0-9]", m)),
    ]
    return next((k for k, hit in tests if hit), "phone")


def split(m):
    kind = kind_of(m)
    lead = {**pii.LEADS, "name": pii.TITLE}.get(kind)
    found = regex.match(lead, m, FLAGS) if lead else None
    n = found.end() if found else 0
    return kind, m[:n], m[n:]


def date_parts(value):
    a, b, c = map(int, regex.split("[-./]", value))
    return (a, b, c) if a > 31 else (c, a, b) if b > 12 else (c, b, a)


def identity(m):
    kind, _, value = split(m)
    digits = regex.sub("[^0-9]", "", value)
    if kind == "email":
        form = value.lower()
    elif kind in ("card", "ssn"):
        form = digits
    elif kind == "phone":
        form = "+" * value.startswith("+") + digits
    elif kind == "iban":
        form = value.replace(" ", "")
    elif kind == "name":
        script = "cyrillic" if regex.match(r"\p{IsCyrillic}", value) else "greek" if regex.match(r"\p{IsGreek}", value) else "latin"
        form = f"{script}\n{value.lower()}"
    elif kind == "birth":
        form = "{:04d}-{:02d}-{:02d}".format(*date_parts(value))
    else:
        form = value
    return f"{kind}\n{form}"


def gender(m):
    for mark, titles in (("f", pii.FEMALE), ("m", pii.MALE), ("u", pii.ANY_GENDER)):
        if regex.match(rf"(?:{titles})\.?[\x20\xA0]", m, FLAGS):
            return mark
    return None


def address(form, seed):
    v = list(map(int, form.split(".")))
    for r in range(4):
        mine, other = (0, 2) if r % 2 == 0 else (2, 0)
        h = sha(seed, r, v[other], v[other + 1])
        by = [int(h[4 * i : 4 * i + 4], 16) for i in range(2)]
        for i in range(2):
            x = v[mine + i]
            if mine + i:
                v[mine + i] = (x + by[i]) % 256
            elif 1 <= x <= 223:
                v[0] = (x - 1 + by[i]) % 223 + 1
            else:
                rest = ((0 if x == 0 else x - 223) + by[i]) % 33
                v[0] = 0 if rest == 0 else rest + 223
    return ".".join(map(str, v))


def surrogate(entity, attempt, key, female):
    kind, form, *name = entity.split("\n")
    seed = f"{key}\n{kind}\n{attempt}"
    if kind == "name":
        words, size = name[0].split(" "), attempt + 3
        figures = stream(f"{seed}\n{name[0]}", len(words) * size)
        out = []
        for i in range(len(words)):
            word = "".join(pii.SYLLABLES[form][int(d, 16)] for d in figures[i * size : (i + 1) * size]) + (pii.ENDINGS[form][female] if i == 0 else "")
            out.append(word[0].upper() + word[1:])
        return " ".join(out)
    if kind == "ip":
        return address(form, seed)
    if kind == "card":
        c = form[0] + feistel(form[1:-1], seed)
        return c + str((luhn(c) + int(form[-1]) - luhn(form[:-1])) % 10)
    if kind == "iban":
        bank = feistel(form[4:], seed)
        return form[:2] + f"{(iban_check(bank, form[:2]) + int(form[2:4]) - iban_check(form[4:], form[:2])) % 100:02d}" + bank
    if kind == "birth":
        try:
            days = (datetime.date.fromisoformat(form) - START).days if form[:2] in ("19", "20") else None
        except ValueError:
            days = None
        if days is None:
            return feistel(form, seed)
        by = int(sha(seed)[:7], 16) % 50_000 + 10_000
        return str(START + datetime.timedelta((days + by) % pii.DAYS))
    keep = {"cloud_key": 4, "phone": len(regex.match(pii.COUNTRY_CODE, form, FLAGS)[0]) if form.startswith("+") else 1}.get(kind, 0)
    tail = len(regex.search(r"\.[^.]*$", form)[0]) if kind == "email" else 0
    return form[:keep] + feistel(form[keep : len(form) - tail], seed) + form[len(form) - tail :]


def normal(entity, found):
    lead = entity[: entity.rindex("\n") + 1]
    return lead + (found.lower() if entity.startswith("name\n") else found)


def shape(entity):
    kind, form = entity.split("\n", 1)
    for a in pii.ALPHABETS:
        form = form.translate({ord(c): a[0] for c in a})
    return kind if kind in ("name", "ip") else f"{kind}\n{form}"


def attempts(known, key):
    state = dict.fromkeys(known, 0)
    for _ in range(pii.ROUNDS):
        made = {e: normal(e, surrogate(e, a, key, False)) for e, a in state.items()}
        by, taken = {}, set()
        for e, m in made.items():
            by.setdefault(m, []).append(e)
            shown = [m] + [normal(e, surrogate(e, state[e], key, True))] * e.startswith("name\n")
            if any(s in known for s in shown):
                taken.add(m)
        moved = {e for m, group in by.items() for e in group if m in taken or (len(group) > 1 and e != min(group))}
        if not moved:
            return state
        state = {e: a + (e in moved) for e, a in state.items()}
    full = {shape(e) for e in moved}
    return {e: 0 if shape(e) in full else a for e, a in state.items()}


def mentions(text):
    """(pattern, mentions) of a text."""
    found = [m[0] for m in regex.finditer(pii.ENTITY, text, FLAGS)] if regex.search("[0-9@=:]", text) or regex.search(pii.TITLE, text, FLAGS) else []
    names = {regex.sub("^" + pii.TITLE, "", m, flags=FLAGS) for m in found if regex.match(pii.TITLE, m, FLAGS) and not regex.search("[0-9@=:]", m)}
    if not names:
        return pii.ENTITY, found
    pattern = pii.ENTITY + r"|(?<![\p{L}'-])(?:" + "|".join(sorted(names, reverse=True)) + r")(?![\p{L}'-])"
    return pattern, [m[0] for m in regex.finditer(pattern, text, FLAGS)]


def dress(m, found):
    kind, lead, value = split(m)
    if kind == "email":
        found = found.upper() if value == value.upper() != value.lower() else found
    elif kind in ("phone", "card", "ssn", "iban"):
        each = iter(found.replace("+", ""))
        found = regex.sub("[0-9A-Z]", lambda _: next(each), value)
    elif kind == "birth" and not regex.match("[0-9]{4}", value):
        mark, (a, b, _) = regex.search("[./]", value)[0], regex.split("[./]", value)
        y, mo, d = map(int, found.split("-"))
        first, second = (mo, d) if int(b) > 12 else (d, mo)
        wide = lambda n, old: f"{n:02d}" if len(old) > 1 else str(n)
        found = f"{wide(first, a)}{mark}{wide(second, b)}{mark}{y:04d}"
    return lead + found


def replace(texts, key):
    """(new text, number of mentions) of each text."""
    told = {}
    for t in texts:
        for m in mentions(t or "")[1]:
            told.setdefault(identity(m), set()).add(gender(m))
    state = attempts(set(told), key)
    out = []
    for t in texts:
        pattern, found = mentions(t or "")

        def swap(m):
            entity, g = identity(m[0]), gender(m[0])
            female = g == "f" or (g in (None, "u") and "f" in told[entity] and "m" not in told[entity])
            return dress(m[0], surrogate(entity, state[entity], key, female))

        out.append((t if t is None else regex.sub(pattern, swap, t, flags=FLAGS), len(found)))
    return out
