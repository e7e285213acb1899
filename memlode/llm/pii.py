"""Personal information in free text: a skip-chain conditional random field over tokens.

Wide patterns cut a text into candidate segments (mail addresses, groups of digits, addresses, capitalized names, single
capitalized words that come up in one of these). Their tokens are the nodes of the field, each labelled with a kind or with nothing.
A token's potential comes from its own features and its share of its segment's (form, surrounding words, given names). Edges
join the tokens of a segment, the ends of neighbouring segments, and, however far apart, equal and similar tokens: the skip
edges. Loopy sum-product messages run over all tokens of a batch of texts at once. All potentials, those of edges too, are learnt
by ascending the likelihood of the field on a bounded sample of the texts, of which only sure cases are labelled and the others
hidden; the field carries the labels over to the unsure ones.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("none", "email", "phone", "id_number", "address", "name")
NONE, EMAIL, PHONE, ID, ADDRESS, NAME = range(6)

# Endings of host names, words around numbers, words of addresses, titles and particles of names.
_TLD = r"(?:com|org|net|edu|gov|mil|int|info|biz|io|dev|app|ai|co|me|eu|example|test|invalid|localhost|[a-z]{2})"
_AT = r"(?:\s?@\s?|\s?＠\s?|%40|&#64;|\s?[\[({<]\s?(?:at|arroba|arobase|chez|@)\s?[\])}>]\s?|\s(?:at|arroba|arobase)\s)"
_DOT = r"(?:\.|．|\s?[\[({<]\s?(?:dot|punto|ponto|point|\.)\s?[\])}>]\s?|\s(?:dot|punto|ponto|point)\s)"
_LOCAL = r"[\p{L}\p{N}][\p{L}\p{N}._%+\-]*"
MAIL = regex.compile(rf"(?<![\p{{L}}\p{{N}}._%+\-@/])({_LOCAL}){_AT}((?:[\p{{L}}\p{{N}}\-]+{_DOT})+){_TLD}(?![\p{{L}}\p{{N}}\-]|\.\p{{L}})", regex.I)
NUMBER = regex.compile(r"(?<![\p{L}\p{N}_./\-+])(?:\+|\(\+?)?\p{Nd}(?:[\p{Nd}()]|[   .\-/](?=[\p{Nd}(])|\)[ .\-]?(?=\p{Nd}))*(?:[ \-]?[A-Z](?![\p{L}\p{N}]))?(?![\p{L}\p{N}_]|[\-/.:]\p{N}?\p{L}{2})")
LETTERED = regex.compile(r"(?<![\p{L}\p{N}_./\-])\p{Lu}{1,2}-?\p{Nd}{6,9}(?:[ \-]?\p{Lu})?(?![\p{L}\p{N}_])")
INSURANCE = regex.compile(r"(?<![\p{L}\p{N}_./\-])\p{Lu}{2}[ \-]?(?:\p{Nd}{6}|\p{Nd}{2}([ \-])\p{Nd}{2}\1\p{Nd}{2})(?:[ \-]?(\p{Lu}))?(?![\p{L}\p{N}_])")
_CAP = r"\p{Lu}[\p{Ll}\p{M}]+(?:['’]\p{Lu}?[\p{Ll}\p{M}]+)?(?:-\p{Lu}[\p{Ll}\p{M}]+)*"
_PARTICLE = r"(?:(?:de|da|do|das|dos|del|della|di|du|la|le|van|von|der|den|ter|bin|al|el|y|e)\s){0,2}"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Dra|Drs|Prof|Profa|Sr|Sra|Srta|Mme|Mlle|Me|Don|Doña|Dona|Señora?|Senhora?|Monsieur|Madame|Mx)"
PERSON = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}_@/\\.:'’\-])(?:{_TITLE}\.?\s(?:(?:{_CAP}|\p{{Lu}}\.)\s)?{_PARTICLE}(?:{_CAP}|\p{{Lu}}{{3,}})"
    rf"|(?:\p{{Lu}}\.\s?){{1,2}}{_PARTICLE}{_CAP}|{_CAP}(?:\s(?:{_CAP}|\p{{Lu}}\.)){{0,2}}\s{_PARTICLE}{_CAP}|{_CAP},\s(?:{_CAP}|\p{{Lu}}\.)"
    rf"|\p{{Lu}}{{3,}}(?:,|\s(?:(?:DE|DA|DEL|VAN|VON|DI)\s)?)\s?\p{{Lu}}{{3,}}(?:-\p{{Lu}}{{3,}})?)(?![\p{{L}}\p{{N}}_/@]|\.\p{{Ll}})"
)
_STREET = r"(?:street|st\.?|avenue|ave\.?|road|rd\.?|lane|ln\.?|drive|dr\.?|court|ct\.?|crescent|place|pl\.?|square|terrace|boulevard|blvd\.?|way|close|parkway|row|alley)"
_VIA = r"(?:rua|avenida|av\.?|travessa|alameda|praça|largo|estrada|rodovia|calle|c/|plaza|paseo|camino|carrera|carretera|ronda|rue|avenue|boulevard|bd\.?|place|chemin|allée|impasse|quai|route|cours)"
_WORDS = r"(?:(?:\p{L}{1,3}\.|[\p{L}'’\-]+)[^\S\n]){0,3}[\p{L}'’\-]+"
_UNIT = r"(?:\s?[,\-]\s?(?:apt|apto|apartment|unit|suite|ste|flat|floor|piso|andar|bloco|casa|sala|puerta|bât|appt|esc|int)\.?\s?[\p{L}\p{N}º°ª]+|\s?,\s?\p{N}+\s?[º°ª]\s?\p{L}?)?"
_CITY = r"(?:\s?[,\-–]\s?(?:(?:CEP|C\.?P\.?)\s?)?(?:[\p{N}\-]{4,9}\s)?(?-i:\p{Lu})[\p{L}'’\-]+(?:[^\S\n](?-i:\p{Lu})[\p{L}'’\-]+(?=[^\S\n][\p{N}]{4}))*(?:,?\s(?:CEP\s)?[\p{N}\-]{4,9})?)?"
PLACE = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}_/\-])(?:(?:(?:flat|unit|apt|suite)\.?\s\p{{N}}+\p{{L}}?,\s)?\p{{N}}{{1,5}}\p{{L}}?\s{_WORDS}\s{_STREET}(?![\p{{L}}\p{{N}}]){_UNIT}{_CITY}"
    rf"|r\.\s{_WORDS},\s(?:n[º°.]{{1,2}}\s?)?\p{{N}}{{1,5}}(?![\p{{N}}\-]){_UNIT}{_CITY}"
    rf"|{_VIA}\s{_WORDS}(?:,?\s(?:n[º°.o]{{1,2}}|num\.?|número|#)?\s?|\s)\p{{N}}{{1,5}}(?![\p{{N}}]){_UNIT}{_CITY}"
    rf"|\p{{N}}{{1,5}}(?:\s?(?:bis|ter|quater))?,?\s{_VIA}\s{_WORDS}{_UNIT}{_CITY}"
    rf"|(?:p\.?\s?o\.?\s?box|post(?:\soffice)?\sbox|apartado(?:\sde\scorreos|\spostal)?|caixa\spostal|casilla(?:\sde\scorreos?)?|bo[iî]te\spostale|bp|cx\.?\spostal)\s(?:n[º°.]{{1,2}}\s?)?\p{{N}}+{_CITY})",
    regex.I,
)
_ID_WORDS = "ssn|soc|sec|social|security|doc|documento|cpf|cnpj|dni|nif|nie|nir|nino|itin|tin|curp|rfc|rg|insee|passport|passeport|pasaporte|passaporte|identity|identidad|identidade|identité|sécu|sécurité|seguridad|segurança|tax|fiscal|contribuinte"
_PHONE_WORDS = "call|phone|tel|telephone|telefone|teléfono|telefono|téléphone|mobile|cell|celular|móvil|movil|portable|pager|dial|dials|sms|whatsapp|fax|ligar|ligue|llamar|llame|appeler|appelez|joindre|ring|text"
_NUMBER_WORDS = "ticket|build|trace|epoch|checksum|sizes|size|run|runs|job|port|code|código|código|error|version|bind|ip|commit|sha|hash|issue|order|invoice|sku|art|port|seed|offset|id|pid|batch|shard"
ID_NEAR, PHONE_NEAR, OTHER_NEAR = (frozenset(w.split("|")) for w in (_ID_WORDS, _PHONE_WORDS, _NUMBER_WORDS))
REPOSITORY = regex.compile(r"^(?:git|hg|svn|ssh)$", regex.I)
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: A capitalized word by itself.
LONE = regex.compile(r"(?<![\p{L}\p{N}_@/\\.:\-])\p{Lu}[\p{Ll}\p{M}]{3,}(?![\p{L}\p{N}_/@]|\.\p{Ll})")
_TITLES = regex.compile(rf"^{_TITLE}\.?\s")
_STOPS = frozenset("the a an of and or for in on at to with from by as ask after before if when el la los las de del con según segundo selon según o os as um uma le les des falar talk hablar".split())


@dataclass
class Span:
    """A candidate segment: its place, what the patterns say of it, its features and its tokens in lower case."""

    start: int
    end: int
    sort: int
    features: list[str]
    sure: int | None = None
    tokens: list[str] = field(default_factory=list)
    lone: bool = False


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    before = [w.lower() for w in WORD.findall(text[max(0, start - 48) : start])][-3:]
    after = [w.lower() for w in WORD.findall(text[end : end + 32])][:2]
    return before, after


def _context(text: str, start: int, end: int) -> tuple[list[str], list[str], list[str]]:
    before, after = _around(text, start, end)
    out = [f"b{i}={w}" for i, w in enumerate(reversed(before))] + [f"a{i}={w}" for i, w in enumerate(after)]
    out.append("bb=" + " ".join(before[-2:]))
    out.append("bc=" + (text[start - 1 : start].strip() or text[max(0, start - 2) : start - 1].strip() or "^"))
    out.append("ac=" + (text[end : end + 1].strip() or "_"))
    return before, after, out


def spans(text: str, given: frozenset[str]) -> list[Span]:
    """All candidates of a text, in order and without overlap; mail addresses come before places, these before numbers and names."""
    plain = unicodedata.normalize("NFKC", text) if not text.isascii() else text
    if len(plain) != len(text):  # keep places: fold character by character
        plain = "".join(c if len(f := unicodedata.normalize("NFKC", c)) != 1 else f for c in text)
    taken = bytearray(len(plain))
    out: list[Span] = []

    def free(m) -> bool:
        return not any(taken[m.start() : m.end()])

    def add(start: int, end: int, sort: int, features: list[str], sure: int | None) -> None:
        taken[start:end] = b"\1" * (end - start)
        out.append(Span(start, end, sort, features, sure, [w.lower() for w in WORD.findall(plain[start:end])] or ["_"]))

    if any(x in plain for x in ("@", "%40", "&#64;")) or regex.search(r"\b(?:at|arroba|arobase|chez)\b", plain, regex.I):
        for m in MAIL.finditer(plain):
            local, value = m[1], m[0]
            after = plain[m.end() : m.end() + 2]
            odd = bool(REPOSITORY.match(local)) or (after[:1] == ":" and after[1:].strip() not in ("", '"'))
            spaced = regex.search(r"\s(?:at|arroba|arobase)\s", value, regex.I)
            host = regex.search(rf"(?:{_DOT})({_TLD})$", value, regex.I)
            short = bool(spaced) and host is not None and len(host[1]) == 2 and "." not in local
            sure = NONE if odd else None if short else EMAIL
            add(m.start(), m.end(), EMAIL, ["mail", f"repo={odd}", f"short={short}", f"spaced={bool(spaced)}"], sure)
    for m in PLACE.finditer(plain):
        if not free(m):
            continue
        value = m[0]
        before, after, context = _context(plain, m.start(), m.end())
        box = regex.match(r"\p{L}", value) is not None and not regex.match(_VIA, value, regex.I)
        proper = regex.search(r"\p{L}{3,}", value) is not None
        city = "," in value or regex.search(r"\d{5}", value) is not None
        add(m.start(), m.end(), ADDRESS, ["place", f"city={city}", f"box={box}", f"city={city},{before[-1] if before else '^'}", *context], ADDRESS if city and proper else None)
    for pattern in (INSURANCE, LETTERED, NUMBER):
        for m in pattern.finditer(plain):
            if not free(m):
                continue
            value = m[0].strip()
            digits = sum(c.isdigit() for c in value)
            before, after, context = _context(plain, m.start(), m.end())
            near = set(before)
            # two letters, six digits and a letter need no word before them; other forms of fewer than seven digits do
            insured = pattern is INSURANCE and m[2] is not None
            if digits > 16 or (digits < 7 and not insured and not near & ID_NEAR):
                continue
            if regex.fullmatch(r"\d{4}-\d\d-\d\d(?:[ T/].*)?|(?:\d{1,3}\.){3}\d{1,3}|\d{1,3}(?:[.,]\d{3})+", value) and not regex.fullmatch(r"\d{3}\.\d{3}\.\d{3}", value):
                continue
            shape = regex.sub(r"\d+", lambda d: str(len(d[0])), regex.sub(r"[\s ]+", "_", value))
            shape = regex.sub(r"\p{Lu}", "A", shape)
            loose = regex.sub(r"[.\-_/]+", "~", shape)
            lead = "+" if value[0] == "+" or value.startswith("(+") else "0" if value[0] == "0" else "(" if value[0] == "(" else "d"
            f = ["number", f"shape={shape}", f"loose={loose}", f"n={digits}", f"lead={lead}", f"lead={lead},n={digits}", f"bare={value.isdigit()}", *context]
            if insured:
                f.append("insured")
            for w in near:
                f += [f"w={w}"]
            kinds = [name for name, ws in (("id", ID_NEAR), ("phone", PHONE_NEAR), ("other", OTHER_NEAR)) if near & ws]
            f += [f"near={k}" for k in kinds]
            sure = ID if "id" in kinds else NONE if "other" in kinds and lead != "+" else PHONE if lead == "+" or "phone" in kinds else None
            if sure is None and insured and m[2] in "ABCD":
                sure = ID
            if digits < 7 and pattern is NUMBER:  # a word alone does not make a short number sure
                sure = None
            elif sure is None and value.isdigit() and lead == "d":
                sure = NONE
            add(m.start(), m.end(), PHONE, f, sure)
    at = 0
    while m := PERSON.search(plain, at):
        start, end = m.span()
        at = end
        if any(taken[start:end]):
            at = start + 1 + next(i for i, x in enumerate(taken[start:end]) if x)
            continue
        value = m[0]
        titled = _TITLES.match(value) is not None
        tokens = [w for w in WORD.findall(value)]
        opens = regex.search(r"(?:^|[.!?:;]\s|\n\s*(?:[-*#>]+\s)*|[-*•]\s|\"|>)$", plain[max(0, start - 6) : start]) is not None
        # a word that only opens the sentence is no part of the name: the search goes on behind it
        if not titled and len(tokens) >= 2 and tokens[0].lower() not in given:
            inner = any(t.lower() in given for t in tokens[1:-1])
            if (tokens[0].lower() in _STOPS and value[1:2] != ".") or (len(tokens) > 2 and (opens or inner) and value[len(tokens[0])] != "," and not regex.match(r"\p{Lu}\.", value)):
                at = start + value.find(tokens[1], len(tokens[0]))
                continue
        if not titled and len(tokens) < 2:
            at = start + 1
            continue
        low = [t.lower() for t in tokens]
        before, after, context = _context(plain, start, end)
        initial = regex.match(r"\p{Lu}\.", value) is not None
        comma = "," in value
        first = low[-1] if comma else low[0]
        given_at = first in given
        f = ["person", f"given={given_at}", f"title={titled}", f"initial={initial}", f"comma={comma}", f"upper={value.isupper()}", f"opens={opens}", f"count={len(low)}", f"end={low[-1][-3:]}", *context]
        add(start, end, NAME, f, NAME if titled or given_at else NAME if initial and len(low[-1]) > 3 else None)
    named = {stem(t) for s in out if s.sort == NAME for t in s.tokens if len(t) > 3}
    if named:
        for m in LONE.finditer(plain):
            if stem(m[0].lower()) in named and free(m):
                _, _, context = _context(plain, m.start(), m.end())
                add(m.start(), m.end(), NAME, ["lone", *context], None)
                out[-1].lone = True
    out.sort(key=lambda s: s.start)
    return out


def stem(token: str) -> str:
    """What similar tokens have in common: the first six letters without accents."""
    if token.isascii():
        return token[:6]
    return "".join(c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c))[:6]


#: Sorts of edges: between tokens of a segment, between neighbouring segments, skip edges of equal and of similar tokens.
INSIDE, NEXT, EQUAL, SIMILAR = range(4)


@dataclass
class Nodes:
    """The tokens of all segments of several texts: the segment of each, and the edges."""

    segment: np.ndarray
    token: list[str]
    a: np.ndarray
    b: np.ndarray
    kind: np.ndarray


def nodes(found: list[list[Span]], skip: bool = True) -> Nodes:
    """A token is joined to the first and to the last token before it that is equal, else similar, in its text: in a star, however often it comes, what one mention tells is two edges away."""
    segment, token, ends = [], [], []
    at = 0
    for row in found:
        seen: dict[tuple[int, str], tuple[int, int]] = {}
        for i, s in enumerate(row):
            if i:
                ends.append((len(token) - 1, len(token), NEXT))
            for j, t in enumerate(s.tokens):
                me = len(token)
                if j:
                    ends.append((me - 1, me, INSIDE))
                segment.append(at + i)
                token.append(t)
                if len(t) < 4 or not skip:
                    continue
                key = (s.sort, stem(t))
                if before := seen.get(key):
                    for other in {*before}:
                        ends.append((other, me, EQUAL if token[other] == t else SIMILAR))
                seen[key] = (before[0] if before else me, me)
        at += len(row)
    e = np.array(ends, dtype="i8").reshape(-1, 3)
    return Nodes(np.array(segment, dtype="i8"), token, e[:, 0], e[:, 1], e[:, 2])


def propagate(scores: np.ndarray, net: Nodes, pair: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Log beliefs of all tokens, and beliefs of the two ends of each edge, after loopy sum-product messages; pair[kind] holds the potentials of two labels."""
    a, b = net.a, net.b
    psi = pair[net.kind]
    forth, back = np.zeros((len(a), scores.shape[1])), np.zeros((len(a), scores.shape[1]))  # to b, to a

    def beliefs() -> np.ndarray:
        out = scores.copy()
        np.add.at(out, b, forth)
        np.add.at(out, a, back)
        return out

    def passed(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        out = (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)
        return out - out.max(axis=1, keepdims=True)

    for _ in range(rounds if len(a) else 0):
        belief = beliefs()
        to_b, to_a = passed(psi + (belief[a] - back)[:, :, None], 1), passed(psi + (belief[b] - forth)[:, None, :], 2)
        forth, back = 0.5 * forth + 0.5 * to_b, 0.5 * back + 0.5 * to_a
    belief = beliefs()
    both = psi + (belief[a] - back)[:, :, None] + (belief[b] - forth)[:, None, :]
    both = np.exp(both - both.max(axis=(1, 2), keepdims=True)) if len(a) else both
    return belief, both / both.sum(axis=(1, 2), keepdims=True) if len(a) else both


#: Labels that a candidate of each sort may get.
ALLOWED = {EMAIL: (NONE, EMAIL), ADDRESS: (NONE, ADDRESS), PHONE: (NONE, PHONE, ID), NAME: (NONE, NAME)}


def token_features(s: Span) -> list[list[str]]:
    """The features of each token of a segment: where in it the token stands and, in names and addresses, what it is."""
    last = len(s.tokens) - 1
    out = []
    for i, t in enumerate(s.tokens):
        f = [f"at={s.sort},{'S' if not last else 'B' if not i else 'E' if i == last else 'I'}"]
        if s.sort in (NAME, ADDRESS) and not s.lone:  # the name of a lone word is told by its other mentions alone
            f.append(f"t={t}")
        out.append(f)
    return out


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    pair: np.ndarray
    given: frozenset[str]
    skip: bool = True

    def scores(self, found: list[Span]) -> np.ndarray:
        """The potential of each token: its own and its share of its segment's."""
        zero, out = np.zeros(len(LABELS)), []
        get = self.weights.get
        for s in found:
            shared = zero
            for f in s.features:
                if (w := get(f)) is not None:
                    shared = shared + w
            shared = shared / len(s.tokens)
            closed = CLOSED[s.sort]
            for own in token_features(s):
                total = shared + closed
                for f in own:
                    if (w := get(f)) is not None:
                        total = total + w
                out.append(total)
        return np.array(out).reshape(-1, len(LABELS))

    def label(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """(start, end, label) of the personal data of each text; a segment has the label that its tokens believe in together."""
        found = [spans(t, self.given) if t else [] for t in texts]
        all_ = [s for row in found for s in row]
        if not all_:
            return [[] for _ in texts]
        net = nodes(found, self.skip)
        belief, _ = propagate(self.scores(all_), net, self.pair)
        belief -= belief.max(axis=1, keepdims=True)
        together = np.zeros((len(all_), len(LABELS)))
        np.add.at(together, net.segment, belief)
        best = together.argmax(axis=1)
        out, at = [], 0
        for row in found:
            out.append([(s.start, s.end, int(best[at + i])) for i, s in enumerate(row) if best[at + i] != NONE])
            at += len(row)
        return out


CLOSED = {sort: np.array([0.0 if k in allowed else -50.0 for k in range(len(LABELS))]) for sort, allowed in ALLOWED.items()}


def sure_cases(found: list[list[Span]], texts: list[str], names: frozenset[str], ordinary: Counter, often: int) -> None:
    """What may be taken for granted in training. Names that end with an ordinary word are none; a lone word is a family
    name if a sure name of its text ends with it, and nothing if it is ordinary or ends none."""
    for row in found:
        family = set()
        for s in row:
            if s.sort == NAME and not s.lone:
                if "title=True" not in s.features:
                    common = [ordinary[t] >= often for t in s.tokens]
                    if common[-1] or (all(common[:-1]) and s.sure is None):
                        s.sure = NONE
                if s.sure == NAME:
                    family.add(s.tokens[-1])
        ends = {s.tokens[-1] for s in row if s.sort == NAME and not s.lone}
        for s in row:
            if s.lone:
                t = s.tokens[0]
                s.sure = NONE if ordinary[t] >= often else NAME if t in family else None if t in ends else NONE


def train(texts: list[str], given: Iterable[str], epochs: int = 30, rate: float = 0.5, decay: float = 1e-4, pair_decay: float = 0.01, joint: int = 12) -> Model:
    """The potentials of the field from the sure cases of the texts.

    The weights of features start from a fit of the segments by themselves; then all potentials, of features and of edges, ascend the
    likelihood of the field: the gradient is what its messages expect with the sure labels given less what they expect
    without. Words that the texts often use in lower case are ordinary words.
    """
    names = frozenset(n.lower() for n in given)
    texts = [t for t in texts if t]
    found = [spans(t, names) for t in texts]
    ordinary: Counter = Counter()
    for t, row in zip(texts, found):
        mails = [(s.start, s.end) for s in row if s.sort == EMAIL]
        for a, b in mails:
            t = t[:a] + " " * (b - a) + t[b:]
        ordinary.update({w for w in WORD.findall(t) if w.islower()})
    often = max(5, len(found) // 2000)
    # a given name that is an ordinary word too proves nothing
    double = {n for n in names if ordinary[n] >= often}
    if double:
        names -= double
        found = [spans(t, names) for t in texts]
    sure_cases(found, texts, names, ordinary, often)
    found = [row for row in found if row]
    flat = [s for row in found for s in row]
    own = [token_features(s) for s in flat]
    seen: Counter = Counter(f for s, tokens in zip(flat, own) if s.sure is not None for f in (*s.features, *(f for t in tokens for f in t)))
    index = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= 2))}
    net = nodes(found)
    first = np.cumsum([0, *(len(s.tokens) for s in flat)])
    # (segment or token, feature); what made a case sure must not be all that is learnt of it: half of the cases don't show it
    seg, seg_f, tok, tok_f = [], [], [], []
    for i, (s, tokens) in enumerate(zip(flat, own)):
        hide = () if i % 2 == 0 or s.lone else ("given=", "title=", "initial=") if s.sort == NAME else ("near=", "w=", "b0=", "b1=", "b2=", "bb=") if s.sort == PHONE else ()
        for f in s.features:
            if f in index and not (hide and f.startswith(hide)):
                seg.append(i)
                seg_f.append(index[f])
        for j, fs in enumerate(tokens):
            for f in fs:
                if f in index:
                    tok.append(int(first[i]) + j)
                    tok_f.append(index[f])
    seg, seg_f, tok, tok_f = (np.array(x, dtype="i8") for x in (seg, seg_f, tok, tok_f))
    closed = np.array([CLOSED[s.sort] for s in flat]).reshape(-1, len(LABELS))
    size = np.diff(first).astype("f8")[:, None] if flat else np.ones((0, 1))
    sure = np.array([-1 if s.sure is None else s.sure for s in flat], dtype="i8")
    known = np.flatnonzero(sure >= 0)
    target = np.eye(len(LABELS))[sure[known]] if len(known) else np.zeros((0, len(LABELS)))
    w = np.zeros((len(index), len(LABELS)))
    pair = np.zeros((4, len(LABELS), len(LABELS)))
    square, square_pair = np.zeros_like(w), np.zeros_like(pair)
    owner = net.segment

    def softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def step(x: np.ndarray, g: np.ndarray, square: np.ndarray, rate: float) -> None:
        square += g * g
        x += rate * g / (np.sqrt(square) + 1e-8)

    for _ in range(epochs if len(known) else 0):
        z = closed.copy()
        np.add.at(z, seg, w[seg_f])
        np.add.at(z, owner[tok], w[tok_f])
        miss = np.zeros_like(z)
        miss[known] = target - softmax(z[known])
        g = np.zeros_like(w)
        np.add.at(g, seg_f, miss[seg])
        np.add.at(g, tok_f, miss[owner[tok]])
        step(w, g / len(known) - decay * w, square, rate)
    many = np.bincount(net.kind, minlength=len(pair))
    held = np.zeros((len(owner), len(LABELS)))  # where a label is given, the others are shut
    given_label = sure[owner]
    held[given_label >= 0] = -50.0
    held[np.flatnonzero(given_label >= 0), given_label[given_label >= 0]] = 0.0
    for _ in range(joint if len(known) else 0):
        z = np.zeros_like(closed)
        np.add.at(z, seg, w[seg_f])
        z = (z / size)[owner] + closed[owner]
        np.add.at(z, tok, w[tok_f])
        (with_, both_with), (free, both_free) = (propagate(z + h, net, pair, 4) for h in (held, 0.0))
        miss = softmax(with_) - softmax(free)
        shared = np.zeros_like(closed)
        np.add.at(shared, owner, miss)
        g = np.zeros_like(w)
        np.add.at(g, seg_f, (shared / size)[seg])
        np.add.at(g, tok_f, miss[tok])
        step(w, g / len(known) - decay * w, square, 0.2 * rate)
        g = np.zeros_like(pair)
        np.add.at(g, net.kind, both_with - both_free)
        g += g.transpose(0, 2, 1)  # edges have no direction
        step(pair, g / np.maximum(1, many)[:, None, None] - pair_decay * pair, square_pair, rate)
    return Model({f: w[i] for f, i in index.items()}, pair, names)


def fit(rows: DataFrame, given_names: DataFrame, *, text: str = "content", name: str = "given_name", sample_rows: int = 20_000, most_names: int = 1_000_000) -> Model:
    """A model trained on at most sample_rows texts (chosen by their hash; all, if there are no more) and the given names, at most most_names."""
    picked = rows.select(F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.octet_length("t") < 65_536))
    total = picked.count()
    rate = min(1.0, 1.2 * sample_rows / max(1, total))
    if rate < 1:
        picked = picked.where(F.pmod(F.xxhash64("t"), F.lit(1 << 40)) < int(rate * (1 << 40)))
    texts = sorted({r["t"] for r in picked.limit(sample_rows).collect()})
    names = [r[0] for r in given_names.select(name).where(F.col(name).isNotNull()).distinct().limit(most_names + 1).collect()]
    if len(names) > most_names:
        raise ValueError(f"more than {most_names} given names; raise most_names")
    return train(texts, names)


def _placeholder(text: str, marks: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, end, k in marks:
        out += [text[at:start], f"[{LABELS[k].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(rows: DataFrame, model: Model, *, id_col: str = "id", text: str = "content") -> DataFrame:
    """(id, redacted, kinds): each text with typed placeholders in place of personal data, and the kinds found.

    All other characters stay as they are. A null text gives null and no kinds, an empty one itself; repeated rows give
    repeated rows. Texts are read whole. The model travels to the tasks; its size is bounded by the sample it was trained on.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)
    picked = rows.select(F.col(id_col).alias("id"), F.col(text).alias("_t"))
    schema = f"id {picked.schema['id'].dataType.simpleString()}, redacted string, kinds array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_t").to_pylist()
            marks = sent.value.label(texts)
            done = [None if t is None else _placeholder(t, m) for t, m in zip(texts, marks)]
            kinds = [sorted({LABELS[k] for _, _, k in m}) for m in marks]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(done, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["id", "redacted", "kinds"])

    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
