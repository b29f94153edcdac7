"""The country and hazard-type dimensions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelanes.functions.guards import once
from tradelanes.functions.text import HAZARD_TYPES

# ---------------------------------------------------------------- fixed values
# Country names and their trade-statistics codes. The order decides which entry
# a partly matching name gets, and which name a code is shown under.
COUNTRIES = [
    ("World", 0),
    ("All", 0),
    ("Austria", 40),
    ("Belgium", 56),
    ("Bulgaria", 100),
    ("Croatia", 191),
    ("Cyprus", 196),
    ("Czech Republic", 203),
    ("Czechia", 203),
    ("Denmark", 208),
    ("Estonia", 233),
    ("Finland", 246),
    ("France", 251),
    ("Germany", 276),
    ("Greece", 300),
    ("Hungary", 348),
    ("Ireland", 372),
    ("Italy", 380),
    ("Latvia", 428),
    ("Lithuania", 440),
    ("Luxembourg", 442),
    ("Malta", 470),
    ("Netherlands", 528),
    ("Poland", 616),
    ("Portugal", 620),
    ("Romania", 642),
    ("Slovakia", 703),
    ("Slovenia", 705),
    ("Spain", 724),
    ("Sweden", 752),
    ("Albania", 8),
    ("Andorra", 20),
    ("Belarus", 112),
    ("Bosnia and Herzegovina", 70),
    ("Iceland", 352),
    ("Kosovo", 412),
    ("Liechtenstein", 438),
    ("Moldova", 498),
    ("Monaco", 492),
    ("Montenegro", 499),
    ("North Macedonia", 807),
    ("Norway", 578),
    ("Russia", 643),
    ("Russian Federation", 643),
    ("San Marino", 674),
    ("Serbia", 688),
    ("Switzerland", 756),
    ("Turkey", 792),
    ("Türkiye", 792),
    ("Ukraine", 804),
    ("United Kingdom", 826),
    ("UK", 826),
    ("Vatican City", 336),
    ("Georgia", 268),
    ("Canada", 124),
    ("Mexico", 484),
    ("United States", 842),
    ("USA", 842),
    ("United States of America", 842),
    ("Argentina", 32),
    ("Bolivia", 68),
    ("Brazil", 76),
    ("Chile", 152),
    ("Colombia", 170),
    ("Ecuador", 218),
    ("Guyana", 328),
    ("Paraguay", 600),
    ("Peru", 604),
    ("Suriname", 740),
    ("Uruguay", 858),
    ("Venezuela", 862),
    ("Afghanistan", 4),
    ("Bangladesh", 50),
    ("Cambodia", 116),
    ("China", 156),
    ("Hong Kong", 344),
    ("India", 356),
    ("Indonesia", 360),
    ("Iran", 364),
    ("Iraq", 368),
    ("Israel", 376),
    ("Japan", 392),
    ("Jordan", 400),
    ("Kazakhstan", 398),
    ("Kuwait", 414),
    ("Laos", 418),
    ("Lebanon", 422),
    ("Malaysia", 458),
    ("Mongolia", 496),
    ("Myanmar", 104),
    ("Nepal", 524),
    ("North Korea", 408),
    ("Oman", 512),
    ("Pakistan", 586),
    ("Philippines", 608),
    ("Qatar", 634),
    ("Saudi Arabia", 682),
    ("Singapore", 702),
    ("South Korea", 410),
    ("Korea", 410),
    ("Sri Lanka", 144),
    ("Syria", 760),
    ("Taiwan", 158),
    ("Thailand", 764),
    ("Turkmenistan", 795),
    ("United Arab Emirates", 784),
    ("UAE", 784),
    ("Uzbekistan", 860),
    ("Vietnam", 704),
    ("Viet Nam", 704),
    ("Yemen", 887),
    ("Algeria", 12),
    ("Angola", 24),
    ("Benin", 204),
    ("Botswana", 72),
    ("Burkina Faso", 854),
    ("Cameroon", 120),
    ("Cote d'Ivoire", 384),
    ("Côte d'Ivoire", 384),
    ("Ivory Coast", 384),
    ("Egypt", 818),
    ("Ethiopia", 231),
    ("Ghana", 288),
    ("Kenya", 404),
    ("Libya", 434),
    ("Madagascar", 450),
    ("Mali", 466),
    ("Morocco", 504),
    ("Mozambique", 508),
    ("Namibia", 516),
    ("Niger", 562),
    ("Nigeria", 566),
    ("Senegal", 686),
    ("South Africa", 710),
    ("Sudan", 729),
    ("Tanzania", 834),
    ("Tunisia", 788),
    ("Togo", 768),
    ("Uganda", 800),
    ("Rwanda", 646),
    ("Zambia", 894),
    ("Zimbabwe", 716),
    ("Chad", 148),
    ("Congo (Brazzaville)", 178),
    ("Djibouti", 262),
    ("Gabon", 266),
    ("Mauritius", 480),
    ("Australia", 36),
    ("Fiji", 242),
    ("New Zealand", 554),
    ("Papua New Guinea", 598),
    ("Costa Rica", 188),
    ("Cuba", 192),
    ("Dominican Republic", 214),
    ("El Salvador", 222),
    ("Guatemala", 320),
    ("Haiti", 332),
    ("Honduras", 340),
    ("Jamaica", 388),
    ("Nicaragua", 558),
    ("Panama", 591),
    ("Puerto Rico", 630),
    ("Trinidad and Tobago", 780),
    ("Azerbaijan", 31),
    ("Falkland Islands", 238),
]
EU27 = [
    40, 56, 100, 191, 196, 203, 208, 233, 246, 251, 276, 300, 348, 372, 380, 428, 440, 442,
    470, 528, 616, 620, 642, 703, 705, 724, 752,
]
# ------------------------------------------------------------------------------

#: A country dictionary larger than this is a mistake, not a dimension.
MAX_COUNTRIES = 2000


def lookup_key(name: Column) -> Column:
    return F.lower(F.trim(name))


@dataclass(frozen=True)
class CountryBook:
    """An ordered country dictionary whose lookups are plain column expressions.

    The entries become literals in the plan, so mapping a name needs neither a
    join nor a shuffle. The number of entries is checked.
    """

    entries: tuple[tuple[str, int, bool], ...]

    def __post_init__(self) -> None:
        if len(self.entries) > MAX_COUNTRIES:
            raise ValueError(f"country dictionary has more than {MAX_COUNTRIES} entries")

    @classmethod
    def standard(cls) -> CountryBook:
        union = set(EU27)
        return cls(tuple((name, code, code in union) for name, code in COUNTRIES))

    @classmethod
    def from_frame(cls, countries: DataFrame) -> CountryBook:
        """Read ``(ord, name, m49, is_eu27)``; refuses more than ``MAX_COUNTRIES`` rows."""
        rows = countries.orderBy("ord").limit(MAX_COUNTRIES + 1).collect()
        return cls(tuple((r["name"], r["m49"], r["is_eu27"]) for r in rows))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, *entry) for i, entry in enumerate(self.entries)]
        return spark.createDataFrame(rows, "ord int, name string, m49 int, is_eu27 boolean")

    @cached_property
    def _exact(self) -> Column:
        first: dict[str, int] = {}
        for name, code, _ in self.entries:
            first.setdefault(name.lower(), code)
        return F.create_map(*[F.lit(x) for pair in first.items() for x in pair])

    @cached_property
    def _ordered(self) -> Column:
        return F.array(
            *[
                F.struct(F.lit(name.lower()).alias("name"), F.lit(code).alias("m49"))
                for name, code, _ in self.entries
            ]
        )

    @cached_property
    def codes(self) -> list[int]:
        """All codes, rising."""
        return sorted({code for _, code, _ in self.entries})

    @cached_property
    def eu_codes(self) -> list[int]:
        return sorted({code for _, code, member in self.entries if member})

    @cached_property
    def _names(self) -> Column:
        first: dict[int, str] = {}
        for name, code, _ in self.entries:
            first.setdefault(code, name)
        return F.create_map(*[F.lit(x) for pair in first.items() for x in pair])

    def code_of(self, name: Column) -> Column:
        """Exact name without regard to case, else the first entry that contains or is contained."""
        key = lookup_key(name)
        # names that aren't an entry work out the key once more, instead of its being held for every name
        code = F.coalesce(F.try_element_at(self._exact, key), once(key, self._partial))
        return F.when(F.length(F.trim(name)) > 0, code)

    def _partial(self, key: Column) -> Column:
        found = F.filter(
            self._ordered,
            lambda entry: F.contains(entry["name"], key) | F.contains(key, entry["name"]),
        )
        return F.get(found, 0)["m49"]

    def name_of(self, code: Column) -> Column:
        return F.try_element_at(self._names, code)

    def is_eu(self, code: Column) -> Column:
        return code.isin(self.eu_codes)


def hazard_types(spark: SparkSession) -> DataFrame:
    rows = [(i, kind, label) for i, (kind, label) in enumerate(HAZARD_TYPES)]
    return spark.createDataFrame(rows, "index int, id string, label string")
