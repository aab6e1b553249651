"""Mapping free-entered values to a canonical list by a BK-tree under a true edit metric.

The reference list and its known other names go into a BK-tree on the driver, whose size is
bounded by the reference list and checked before it is broadcast; beyond the bound the list
is cut into shards, each broadcast in turn, and the nearest of the shards' winners is kept.
Values are looked up where they lie: no row is shuffled, each task remembers the answers it
has given, and a value that fills a third of the table costs one look-up for each task.

The tree's metric is the Levenshtein distance, so its pruning by the triangle inequality
loses no entry. Values are judged by the Damerau-Levenshtein distance, in which swapped
neighbours are one edit; as that is at least half the tree's, a reach twice as wide in the
tree returns every entry within it.

Null and blank values give null. A value without an entry in reach gives ``NONE``. Of
entries equally near, the one with the most letters in common at the start wins, then the
smaller code.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that one broadcast tree may hold.
SHARD_ENTRIES = 50_000

UNMATCHED = "NONE"

#: Names in use that no locale data has, by country code.
OTHER_NAMES = {
    "US": "usa|u s a|u s|america|the states|united states of america|estados unidos|сша|америка",
    "GB": "uk|u k|g b|great britain|britain|united kingdom of great britain and northern ireland|england|scotland|wales|northern ireland|cornwall",
    "DE": "ger|brd|ddr|west germany|east germany|federal republic of germany|bavaria|bayern|saxony|sachsen|hessen|berlin|hamburg|bremen|brandenburg|thuringen|saarland",
    "NL": "holland|the netherlands|nederland|north holland|south holland|friesland|utrecht|zeeland",
    "CH": "switz|schweiz|suisse|svizzera|helvetia|confoederatio helvetica",
    "AT": "oesterreich|osterreich|tirol|tyrol|styria|carinthia",
    "RU": "rf|rossiya|rossia|russian federation|siberia",
    "CN": "p r china|pr china|prc|peoples republic of china|mainland china",
    "KR": "한국|s korea|republic of korea|rok|korea south|korea republic of",
    "KP": "n korea|dprk|democratic peoples republic of korea|korea north",
    "NZ": "n z|aotearoa|nz",
    "AE": "emirates|uae|u a e|abu dhabi|dubai",
    "CZ": "czechia|czech rep|ceska republika|cesko|bohemia|moravia",
    "BA": "bosnia|bosnia herzegovina|bosnia hercegovina|bih|republika srpska",
    "MK": "macedonia|fyrom|republic of north macedonia",
    "DO": "dominican rep|republica dominicana",
    "GR": "hellas|hellenic republic|crete",
    "HU": "magyarorszag",
    "HR": "hrvatska|dalmatia|istria",
    "ES": "catalonia|andalusia|galicia|basque country|canary islands",
    "IT": "sicily|sardinia|tuscany|lombardy",
    "FR": "brittany|normandy|corsica|provence|republique francaise",
    "PT": "madeira|azores|portugal continental",
    "BE": "flanders|wallonia",
    "IE": "eire|republic of ireland",
    "CA": "ontario|quebec|british columbia|alberta|manitoba|saskatchewan|nova scotia|new brunswick|newfoundland",
    "AU": "nsw|new south wales|victoria|queensland|tasmania|south australia|western australia|northern territory",
    "VN": "viet nam",
    "IR": "persia|islamic republic of iran",
    "SY": "syrian arab republic",
    "TR": "turkiye",
    "LA": "lao pdr",
    "TZ": "zanzibar",
    "MY": "sarawak|sabah",
    "ZA": "rsa|s africa|suid afrika",
    "IN": "bharat",
    "JP": "nippon|nihon",
}

#: States of the United States; Georgia is left to the country of that name.
US_STATES = (
    "alabama|alaska|arizona|arkansas|california|colorado|connecticut|delaware|florida|hawaii|idaho|illinois|indiana|iowa|kansas|kentucky|"
    "louisiana|maine|maryland|massachusetts|michigan|minnesota|mississippi|missouri|montana|nebraska|nevada|new hampshire|new jersey|"
    "new mexico|new york|north carolina|north dakota|ohio|oklahoma|oregon|pennsylvania|rhode island|south carolina|south dakota|tennessee|"
    "texas|utah|vermont|virginia|washington|west virginia|wisconsin|wyoming"
)

#: States and provinces of other large countries, but for names that several countries have.
OTHER_STATES = {
    "IN": "andhra pradesh|arunachal pradesh|assam|bihar|chhattisgarh|goa|gujarat|haryana|himachal pradesh|jharkhand|karnataka|kerala|madhya pradesh|maharashtra|manipur|meghalaya|mizoram|nagaland|odisha|rajasthan|sikkim|tamil nadu|telangana|tripura|uttar pradesh|uttarakhand|west bengal",
    "BR": "acre|alagoas|amapa|bahia|ceara|espirito santo|goias|maranhao|mato grosso|mato grosso do sul|minas gerais|para|paraiba|parana|pernambuco|piaui|rio de janeiro|rio grande do norte|rio grande do sul|rondonia|roraima|santa catarina|sao paulo|sergipe|tocantins",
    "CN": "anhui|fujian|gansu|guangdong|guangxi|guizhou|hainan|hebei|heilongjiang|henan|hubei|hunan|inner mongolia|jiangsu|jiangxi|jilin|liaoning|ningxia|qinghai|shaanxi|shandong|shanxi|sichuan|tibet|xinjiang|yunnan|zhejiang",
    "MX": "aguascalientes|baja california|campeche|chiapas|chihuahua|coahuila|colima|durango|guanajuato|guerrero|jalisco|michoacan|morelos|nayarit|nuevo leon|oaxaca|puebla|queretaro|quintana roo|san luis potosi|sinaloa|sonora|tabasco|tamaulipas|tlaxcala|veracruz|yucatan|zacatecas",
}

#: Entries of a reference list that may be brought to the driver to build its trees.
MOST_ENTRIES = 2_000_000

#: Languages whose names of the countries are taken from the JVM's locale data.
LANGUAGES = "en de fr es it pt nl ru bg uk pl cs sk sl hr sr hu ro sv nb da fi et lv lt el tr sq mk is ga ca zh ja ko hi ar fa he af vi th ka hy az kk".split()


def normal(s: str) -> str:
    """Lower case, no accents, and single spaces for all else but letters and digits."""
    s = unicodedata.normalize("NFKD", s).casefold()
    s = "".join(c for c in s if not unicodedata.combining(c))
    return " ".join(re.findall(r"[^\W_]+", s))


def edit_distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    far = la + lb
    d = [[far] * (lb + 2) for _ in range(la + 2)]
    for i in range(la + 1):
        d[i + 1][1] = i
    for j in range(lb + 1):
        d[1][j + 1] = j
    seen: dict[str, int] = {}
    for i in range(1, la + 1):
        at = 0
        for j in range(1, lb + 1):
            k, m = seen.get(b[j - 1], 0), at
            same = a[i - 1] == b[j - 1]
            if same:
                at = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        seen[a[i - 1]] = i
    return d[la + 1][lb + 1]


def _masks(a: str) -> dict[str, int]:
    """The places of each letter, as bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def levenshtein(a: str, b: str, masks: dict[str, int] | None = None) -> int:
    """Levenshtein distance, a column of the table at a time in the bits of an integer; ``masks`` are those of ``a``."""
    if not a or not b:
        return len(a) or len(b)
    get = (_masks(a) if masks is None else masks).get
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, d = full, 0, len(a)
    for c in b:
        m = get(c, 0)
        zero = (((m & up) + up) ^ up) | m | down
        right, left = down | (full & ~(zero | up)), up & zero
        if right & top:
            d += 1
        elif left & top:
            d -= 1
        right = right << 1 | 1
        up, down = (left << 1 | ~(zero | right)) & full, right & zero & full
    return d


class BKTree:
    """Entries by their distance from a parent; ``within`` returns every entry in reach."""

    def __init__(self, entries: Iterable[tuple[str, str]]):
        self.root: list | None = None
        for name, code in entries:
            self.add(name, code)

    def add(self, name: str, code: str) -> None:
        if self.root is None:
            self.root = [name, {code}, {}]
            return
        node = self.root
        while True:
            d = levenshtein(name, node[0])
            if d == 0:
                node[1].add(code)
                return
            if d not in node[2]:
                node[2][d] = [name, {code}, {}]
                return
            node = node[2][d]

    def within(self, s: str, reach: int) -> list[tuple[int, str, str]]:
        found, todo, wide, masks = [], [self.root] if self.root else [], 2 * reach, _masks(s)
        while todo:
            name, codes, children = todo.pop()
            d = levenshtein(s, name, masks)
            if d <= wide and (e := edit_distance(s, name)) <= reach:
                found += [(e, name, c) for c in codes]
            todo += [child for k, child in children.items() if d - wide <= k <= d + wide]
        return found


def reach_of(s: str) -> int:
    """Edits allowed for a value of this length: 0 below 3 letters, then 1, 2 from 6, 3 from 11."""
    n = len(s)
    return 0 if n < 3 else 1 if n < 6 else 2 if n < 11 else 3


def _pieces(raw: str) -> Iterator[str]:
    """The value, the value without brackets, and its parts between separators, last first."""
    yield normal(raw)
    bare = re.sub(r"[(\[{].*?[)\]}]", " ", raw)
    yield normal(bare)
    parts = [normal(p) for p in re.split(r"[,/;|:]|\s-\s|[()\[\]]", raw)]
    yield from reversed([p for p in parts if p])


class Matcher:
    """Look-ups in the names of one shard; answers are keys that sort by how near they are.

    In order: the value or a part of it is a name; the whole value is near a name; a name
    stands at its start or end; a part of it is near a name. Names from locale data count in
    the first place only.
    """

    def __init__(self, exact: dict[str, str], tree: BKTree, within: set[str]):
        self.exact, self.tree, self.within, self.memo = exact, tree, within, {}
        self.most_words = max((n.count(" ") + 1 for n in exact), default=0)
        self.longest = max(map(len, exact), default=0)

    def near(self, s: str, stage: int) -> str | None:
        if len(s) > self.longest + reach_of(s):  # longer than any name in reach
            return None

        def key(hit: tuple[int, str, str]) -> str:
            d, name, code = hit
            same = next((i for i, (x, y) in enumerate(zip(name, s, strict=False)) if x != y), min(len(name), len(s)))
            return f"{stage}{d:03d}{999 - same:03d}{code}"

        return min(map(key, self.tree.within(s, reach_of(s))), default=None)

    def match(self, raw: str) -> str:
        pieces = [p for p in dict.fromkeys(_pieces(raw)) if p]
        for k, p in enumerate(pieces):
            for form in (p, p.replace(" ", ""), p.removeprefix("the "), p.removeprefix("la ")):
                if form in self.exact:
                    return f"0{k:06d}{self.exact[form]}"
        whole = [h for p in pieces[:1] for x in {p, p.replace(" ", "")} if (h := self.near(x, 1))]
        if whole:
            return min(whole)
        for k, p in enumerate(pieces):  # the longest name first
            words = p.split()
            for n in range(min(len(words) - 1, self.most_words), 0, -1):
                for form in (" ".join(words[-n:]), " ".join(words[:n])):
                    if len(form) > 3 and form in self.within:
                        return f"2{k:03d}{999 - n:03d}{self.exact[form]}"
        return min((h for p in pieces[1:] for x in {p, p.replace(" ", "")} if (h := self.near(x, 3))), default="9000000" + UNMATCHED)

    def __call__(self, raw: str) -> str:
        out = self.memo.get(raw)
        if out is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            out = self.memo[raw] = self.match(raw)
        return out


def reference_list(df: DataFrame, code: str, name: str) -> list[tuple[str, str]]:
    """(code, name) of a reference table, whose size is checked before it is brought to the driver."""
    n = df.count()
    if n > MOST_ENTRIES:
        raise ValueError(f"{n} entries are too many for trees built on the driver; cut the list by a hash and keep the nearest of its parts' winners")
    return [(r[0], r[1]) for r in df.where(F.col(code).isNotNull() & F.col(name).isNotNull()).select(code, name).orderBy(code, name).collect()]


def _cities(spark: SparkSession, codes: set[str]) -> dict[str, set[str]]:
    """The places after which time zones are called, and the country of each, from the JVM's locale data."""
    icu = spark._jvm.com.ibm.icu
    zones, names = icu.util.TimeZone, icu.text.TimeZoneNames.getInstance(icu.util.ULocale("en"))
    out: dict[str, set[str]] = {}
    for zone in zones.getAvailableIDs(getattr(zones, "SystemTimeZoneType").CANONICAL_LOCATION, None, None):
        if (code := zones.getRegion(zone)) in codes and (place := names.getExemplarLocationName(zone)):
            out.setdefault(normal(place.split(",")[0]), set()).add(code)
    return out


def country_names(spark: SparkSession, reference: list[tuple[str, str]], places: dict[str, str] | None = None) -> dict[str, str]:
    """Other names of the reference countries, by code, locale data and places in them; names of several countries are left out.

    ``places`` is a gazetteer of one's own, from place to code, which goes before all but the
    reference's own names.
    """
    locale = spark._jvm.java.util.Locale
    others: dict[str, set[str]] = {}
    languages = [locale(x) for x in LANGUAGES]
    for code, _ in reference:
        place = locale("", code)
        names = {code, place.getISO3Country(), *(place.getDisplayCountry(x) for x in languages)}
        names |= {*OTHER_NAMES.get(code, "").split("|")}
        if code == "US":
            names |= {*US_STATES.split("|")}
        for n in map(normal, names):
            if n:
                others.setdefault(n, set()).add(code)
    codes = {code for code, _ in reference}
    parts = _cities(spark, codes)
    for code in codes & set(OTHER_STATES):
        for n in OTHER_STATES[code].split("|"):
            parts.setdefault(n, set()).add(code)
    for n, of in parts.items():  # a country's name goes before a place of that name
        if n and n not in others:
            others[n] = of
    own = {normal(name): code for code, name in reference}
    given = {normal(n): c for n, c in (places or {}).items() if c in codes}
    return {n: next(iter(c)) for n, c in others.items() if len(c) == 1} | given | own


def _look_up(values: Iterator[pd.Series], shard) -> Iterator[pd.Series]:
    matcher = shard.value
    for s in values:
        codes, uniques = pd.factorize(s)
        known = [None if not isinstance(u, str) or not u.strip() else matcher(u) for u in uniques]
        yield pd.Series([known[c] if c >= 0 else None for c in codes], dtype=object)


def map_values(df: DataFrame, value: Column, reference: list[tuple[str, str]], out: str, names: dict[str, str] | None = None, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``df`` with the column ``out``: the code of the entry meant by ``value``, ``NONE``, or null for no value.

    ``reference`` holds (code, name) pairs, ``names`` more names by normal form. Names that
    are short or come from locale data match only exactly; the trees hold the reference's own
    names and the longer of the others listed here, ``shard_entries`` in each.
    """
    names = names if names is not None else {normal(n): c for c, n in reference}
    listed = {x for v in OTHER_NAMES.values() for x in v.split("|")}
    own = {normal(n) for _, n in reference}
    plain, near = own | listed, own | {x for x in listed if len(x) > 6}
    items = sorted(names.items())
    context = df.sparkSession.sparkContext
    winners = []
    for k in range(0, max(1, len(items)), shard_entries):
        shard = dict(items[k : k + shard_entries])
        exact = {n.replace(" ", ""): c for n, c in shard.items() if len(n) > 3} | shard
        tree = BKTree((n, c) for n, c in shard.items() if n in near)
        look_up = F.pandas_udf(partial(_look_up, shard=context.broadcast(Matcher(exact, tree, {n for n in shard if n in plain}))), "string", F.PandasUDFType.SCALAR_ITER)
        winners.append(look_up(value))
    best = winners[0] if len(winners) == 1 else F.least(*winners)
    return df.withColumn(out, F.substring(best, 8, 1_000))
