"""Public-suffix rules and the split of a hostname into subdomain, domain and suffix.

The built-in rules become literal sets inside one expression per label count. A list of any length
is a table, looked up once per label count by hash joins. Both are plain string arithmetic in the
scan stage, without a shuffle (as long as the table can be broadcast) and without a UDF.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.functions.punycode import to_ascii
from hostlens.functions.stage import computed_once
from hostlens.sources.scratch import broadcast_if_small, durable

# Generic top-level domains.
GENERIC_TLDS = """
com org net edu gov mil int arpa info biz name pro mobi museum coop aero jobs travel tel cat
asia post xxx app dev page web online site website space store shop top club xyz icu buzz live
cloud tech blog art news media agency digital design studio email support services solutions
systems network group team world today life fun games game work works zone link click download
stream video photo photos pics photography gallery music film movie tube social chat community
wiki academy school university college education training institute foundation ngo ong bank
finance financial money loan loans credit cash fund capital insurance tax legal law lawyer
attorney doctor dental health healthcare care clinic hospital pharmacy fitness yoga diet
restaurant cafe bar pub pizza wine beer coffee recipes kitchen food house homes properties
property estate land rent rentals apartments villas hotel holiday vacations tours cruises
flights taxi cars auto bike motorcycles racing football golf tennis hockey soccer bet casino
poker date dating wedding family kids baby toys gift gifts flowers fashion shoes clothing
jewelry beauty hair style sale deals discount coupons bargains market marketing markets
"""

# Labels under a country code that are themselves open for registration.
COUNTRY_SECOND_LEVELS = """
ac: com edu gov net mil org
ae: co net org sch ac gov mil
ar: com edu gob gov int mil net org tur
at: ac co gv or
au: com net org edu gov asn id
az: com net int gov org edu info pp mil name pro biz
bh: com edu net org gov
bn: com edu gov net org
bo: com edu gob int org net mil tv web
br: com net org gov edu mil art adv eco eng blog ind inf jus leg med mus nom psc rec tur tv wiki
by: gov mil com of
bw: co org
bz: co com net org edu gov
cl: co gob gov mil
cn: ac com edu gov net org mil
co: com edu gov mil net nom org
cr: ac co ed fi go or sa
cu: com edu gob inf nat net org
cy: ac biz com ekloges gov ltd mil net org press pro tm
do: art com edu gob gov mil net org sld web
dz: art asso com edu gov net org pol soc tm
ec: com info net fin k12 med pro org edu gov gob mil
ee: edu gov riik lib med com pri aip org fie
eg: com edu eun gov mil name net org sci
es: com nom org gob edu
et: com gov org edu biz name info net
fj: ac biz com gov info mil name net org pro
fr: asso com gouv nom prd tm
ge: com edu gov org mil net pvt
gh: com edu gov org mil
gr: com edu net org gov
gt: com edu gob ind mil net org
hk: com edu gov idv net org
hn: com edu org net mil gob
hr: iz from name com
hu: co info org priv sport tm agrar bolt film forum games hotel news shop video
id: ac biz co desa go mil my net or ponpes sch web
il: ac co gov idf k12 muni net org
im: ac co com net org tt tv
in: ac co edu firm gen gov ind mil net nic org res
iq: gov edu mil com org net
ir: ac co gov id net org sch
it: gov edu
jo: com org net edu sch gov mil name
jp: ac ad co ed go gr lg ne or
ke: ac co go info me mobi ne or sc
kr: ac co es go hs kg mil ms ne or pe re sc
kw: com edu emb gov ind net org
kz: org edu net gov mil com
lb: com edu gov net org
lk: gov sch net int com org edu ngo soc web ltd assn grp hotel ac
ly: com net gov plc edu sch med org id
ma: co net gov org ac press
mo: com net org edu gov
mt: com edu net org
mx: com org gob edu net
my: com net org gov edu mil name biz
na: co com org
ng: com edu gov i mil mobi name net org sch
ni: ac biz co com edu gob in info int mil net nom org web
nz: ac co cri geek gen govt health iwi kiwi maori mil net org parliament school
om: co com edu gov med museum net org pro
pa: ac gob com org sld edu net ing abo med nom
pe: edu gob nom mil org com net
ph: com net org gov edu ngo mil i
pk: com net edu org fam biz web gov gob gok gon gop gos info
pl: com net org aid agro atm auto biz edu gmina gov info media nieruchomosci nom powiat pc priv
pr: com net org gov edu isla pro biz info name est prof ac
pt: net gov org edu int publ com nome
py: com coop edu gov mil net org
qa: com edu gov mil name net org sch
ro: arts com firm info nom nt org rec store tm www
rs: ac co edu gov in org
rw: ac co coop gov mil net org
sa: com net org gov med pub edu sch
sg: com net org gov edu
sv: com edu gob org red
th: ac co go in mi net or
tn: com ens fin gov ind info intl mincom nat net org perso tourism
tr: av bbs bel biz com dr edu gen gov info k12 kep mil name net org pol tel tsk tv web
tt: co com org net biz info pro int coop jobs mobi travel museum aero name gov edu
tw: edu gov mil com net org idv game ebiz club
tz: ac co go hotel info me mil mobi ne or sc tv
ua: com edu gov in net org kiev kharkov lviv odessa
ug: co or ac sc go ne com org
uk: ac co gov ltd me net nhs org plc police
uy: com edu gub mil net org
uz: co com net org
ve: arts bib co com e12 edu firm gob gov info int mil net nom org rar rec store tec web
vn: com net org edu gov int ac biz info name pro health
za: ac agric alt co edu gov grondar law mil net ngo nic nis nom org school tm web
zm: ac biz co com edu gov info mil net org sch
zw: ac co gov mil org
"""

# Rules where every label one level down is a suffix, and their exceptions.
WILDCARD_RULES = """
*.bd *.ck *.er *.fk *.jm *.kh *.mm *.np *.pg *.sch.uk
*.kawasaki.jp *.kitakyushu.jp *.kobe.jp *.nagoya.jp *.sapporo.jp *.sendai.jp *.yokohama.jp
!www.ck !city.kawasaki.jp !city.kitakyushu.jp !city.kobe.jp !city.nagoya.jp !city.sapporo.jp
!city.sendai.jp !city.yokohama.jp
"""

_RULE_TEXT = re.compile(r"(?:!|\*\.)?[^\s!*/'\"\\]+")


@dataclass(frozen=True)
class SuffixRules:
    """Suffix rules by kind; `any_country` accepts each assigned two-letter ending."""

    exact: frozenset[str]
    wildcard: frozenset[str]
    exception: frozenset[str]
    any_country: bool = False

    @staticmethod
    def parse(rules, any_country: bool = False) -> "SuffixRules":
        exact, wildcard, exception = set(), set(), set()
        for rule in rules:
            rule = rule.strip().lower()
            if not _RULE_TEXT.fullmatch(rule):
                raise ValueError(f"not a suffix rule: {rule!r}")
            if rule.startswith("*."):
                wildcard.add(rule[2:])
            elif rule.startswith("!"):
                exception.add(rule[1:])
            else:
                exact.add(rule)
        return SuffixRules(
            frozenset(exact), frozenset(wildcard), frozenset(exception), any_country
        )

    @property
    def depth(self) -> int:
        """Most labels a suffix (or an exception host) can have."""
        return max(
            [1]
            + [r.count(".") + 1 for r in self.exact | self.exception]
            + [r.count(".") + 2 for r in self.wildcard]
        )


def default_rules() -> SuffixRules:
    rules = GENERIC_TLDS.split() + WILDCARD_RULES.split()
    for line in COUNTRY_SECOND_LEVELS.strip().splitlines():
        country, labels = line.split(":")
        rules += [f"{label}.{country}" for label in labels.split()]
    return SuffixRules.parse(rules, any_country=True)


END_OF_PUBLIC_PART = "===END ICANN DOMAINS==="


@dataclass(frozen=True)
class SuffixTable:
    """Suffix rules as a table (name, exact, below, except), one row per name in ASCII: the name is a
    suffix, each label below it makes one, or it is an exception. `labels`: the most a name has."""

    rules: DataFrame
    labels: int

    def suffix_labels(self, df: DataFrame, host: str, out: str) -> DataFrame:
        """Add how many labels the public suffix of the host has; 0 when no rule matches.

        The host's last 1, 2, ... labels are looked up in turn. An exception wins, then the longest
        match. Hosts match in either spelling, since both sides are compared in ASCII; a NULL host has 0.
        """
        h = F.col(host)
        df = computed_once(df, {"_ascii": to_ascii(host), "_n": F.regexp_count(h, F.lit("[.]")) + 1})
        exception, longest = F.lit(None).cast("int"), F.lit(0)
        found = []
        for k in range(1, self.labels + 1):
            rules = self.rules.select(
                F.col("name").alias(f"_name{k}"), *[F.col(c).alias(f"_{c}{k}") for c in ("exact", "below", "except")]
            )
            found += rules.columns
            last = F.when(F.col("_n") >= k, F.substring_index("_ascii", ".", -k))
            df = df.join(rules, last == F.col(f"_name{k}"), "left")
            longest = (
                F.when(F.col(f"_below{k}") & (F.col("_n") > k), k + 1).when(F.col(f"_exact{k}"), k).otherwise(longest)
            )
            exception = F.when(F.col(f"_except{k}"), k - 1).otherwise(exception)
        return df.withColumn(out, F.coalesce(exception, longest)).drop("_ascii", "_n", *found)


def suffix_table(rules: DataFrame) -> SuffixTable:
    """The table of a column `rule` of rules (`co.uk`, `*.ck`, `!www.ck`), in any order, of any length,
    in either spelling. Repeated rules count once; text that is no rule fails."""
    rule = F.lower(F.trim("rule"))
    plain = rules.select(rule.alias("rule"), F.regexp_replace(rule, r"^(\*\.|!)", "").alias("plain"))
    names = plain.withColumn("name", to_ascii("plain"))
    table = durable(names.groupBy("name").agg(
        F.bool_or(~F.col("rule").rlike(r"^[*!]")).alias("exact"), F.bool_or(F.col("rule").startswith("*.")).alias("below"),
        F.bool_or(F.col("rule").startswith("!")).alias("except"),
        F.max(F.when(~F.col("rule").rlike(rf"^{_RULE_TEXT.pattern}$"), F.col("rule"))).alias("odd"),
    ))
    odd, labels = table.agg(F.max("odd"), F.max(F.regexp_count("name", F.lit("[.]")) + 1)).first()
    if odd is not None:
        raise ValueError(f"not a suffix rule: {odd!r}")
    return SuffixTable(broadcast_if_small(table.drop("odd")), labels or 0)


def read_rules(spark: SparkSession, path: str) -> SuffixTable:
    """Rules from a public-suffix text file: one per line, `//` comments, public (ICANN) part only."""
    # The part before the mark; a list is read as one text value.
    text = spark.read.text(path, wholetext=True).select(F.split_part("value", F.lit(END_OF_PUBLIC_PART), F.lit(1)).alias("value"))
    lines = text.select(F.explode(F.split("value", r"\R")).alias("line"))
    rule = F.regexp_extract("line", r"^\s*(\S+)", 1)
    return suffix_table(lines.where(~F.col("line").startswith("//")).select(rule.alias("rule")).where("rule != ''"))


def with_suffix_labels(df: DataFrame, host: str, rules: SuffixRules | SuffixTable, out: str) -> DataFrame:
    """Add how many labels the public suffix of the host column has, by either kind of rules."""
    if isinstance(rules, SuffixTable):
        return rules.suffix_labels(df, host, out)
    return df.withColumn(out, suffix_labels(host, rules))


def suffix_labels(host: str, rules: SuffixRules) -> Column:
    """How many labels the public suffix of the host column has; 0 when no rule matches.

    Written as SQL text: hundreds of literals parse in one go, and IN over literals is a hash
    lookup at run time.
    """
    h = f"`{host}`"

    def last(k: int) -> str:
        return f"substring_index({h}, '.', -{k})"

    def of_depth(names, k: int) -> str:
        return ", ".join(f"'{r}'" for r in sorted(names) if r.count(".") + 1 == k)

    branches = []
    for k in range(rules.depth, 0, -1):
        if names := of_depth(rules.exception, k):
            branches.append(f"WHEN {last(k)} IN ({names}) THEN {k - 1}")
    for k in range(rules.depth, 0, -1):
        if names := of_depth(rules.wildcard, k - 1):
            branches.append(
                f"WHEN regexp_count({h}, '[.]') >= {k - 1} AND {last(k - 1)} IN ({names}) THEN {k}"
            )
        if names := of_depth(rules.exact, k):
            branches.append(f"WHEN {last(k)} IN ({names}) THEN {k}")
    if rules.any_country:
        # Two-letter endings are country codes, but for those kept out of assignment.
        closed = of_depth(rules.wildcard, 1) or "''"
        branches.append(
            f"WHEN {last(1)} RLIKE '^[a-z][a-z]$' AND {last(1)} NOT RLIKE "
            f"'^(aa|q[m-z]|x[a-z]|zz)$' AND {last(1)} NOT IN ({closed}) THEN 1"
        )
    return F.expr(f"CASE {' '.join(branches)} ELSE 0 END")
