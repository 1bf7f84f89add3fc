"""URL filter: rules by host and path first, else logistic regression on hashed character n-grams.

The model is fitted on the driver from a small labelled table (at most `MAX_LABELLED` rows, checked), so its weights
are one fixed array whatever the input's size. Scoring is one vectorised pass without a shuffle.

The default table names general topics, six or three hosts each, in forms that both kinds share. A regression on n-grams
knows words of a host that it has seen parts of: `held_out_figures` tells how far it goes beyond them.

Defined results: a null URL or one without `://` has an empty host and path, no rule and the score of no n-gram at all.
A score equal to the threshold blocks. Repeated rows and rows with a null page_id are judged alike; very long URLs are
judged whole. An empty table gives an empty result. Extra columns of the input are kept by `judge`,
but for those whose names it writes, which it replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import _BYTE, _SLOT, mix, slices, table

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
MAX_LABELLED = 10_000
#: How much the n-grams of longer hosts are damped (0.5: to length one), and what a path weighs beside its host.
HOST_POWER, PATH_SHARE = 0.4, 0.25

#: Topics of hosts in the labelled table, unwanted and wanted, and what names of both kinds are made with.
UNWANTED = (
    "casino casinos poker roulette jackpot slots blackjack betting bets sportsbet bookmaker lottery gamble "
    "pills pharmacy viagra cialis tablets steroids slimming xxx porn sex adult adults escorts webcams nude erotic hookup "
    "payday loans debt forex bitcoin airdrop giveaway prize winner lucky sweepstakes replica counterfeit "
    "adserver ads adclick banner popup tracker tracking clicks affiliate spam backlinks linkfarm doorway "
    "warez keygen cracks torrents malware phishing verify-login unlock-account"
).split()
WANTED = (
    "news library university museum recipes garden weather history science music city council travel forum docs wiki gazette theatre hiking "
    "school kitchen river mountain health medicine clinic library books poems grammar dictionary maps railway airport harbour bakery "
    "football cricket chess cycling sailing painting pottery photography cinema radio journal archive software compiler database linux python "
    "mathematics physics chemistry biology astronomy geology climate energy forest farming animals birds insects ocean islands castle "
    "parliament justice police elections census economy banking insurance housing gardenia camping children parents family church festival "
    "zeitung schule wissen rathaus wetter biblioteca escuela cultura deporte salud musee cuisine jardin ecole actualites"
).split()
AFFIXES = ("best", "my", "the", "online", "free", "cheap", "daily", "top", "local", "world", "club", "zone", "hub", "shop", "24", "360")
ENDINGS = (".com", ".net", ".org", ".info", ".co.uk", ".de", ".fr", ".es", ".io", ".biz")
TAILS = ("/", "/index.html", "/about", "/archive/2021/07", "/item?id=44", "/a/b/c.php", "/en/start", "/category/all#list")
#: Host words held out at once when the model is judged on hosts that it has not seen.
FOLDS = 10


@dataclass(frozen=True)
class UrlRule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def label(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


def labelled_urls() -> pd.DataFrame:
    """The default training table: url, unwanted, word (the topic of its host). Both kinds have the same forms."""
    rows = []
    for unwanted, words, each in ((1, UNWANTED, 6), (0, WANTED, 3)):
        for k, w in enumerate(words):
            for j in range(each):
                n = 7 * k + 5 * j
                affix, sep = AFFIXES[n % len(AFFIXES)], ("-", "", "-")[(k + j) % 3]
                name = w if j == 0 else w + sep + affix if (k + j) % 2 else affix + sep + w
                head = ("", "www.", "", "m.", "blog.")[n % 5]
                rows.append((f"{('http', 'https')[j % 2]}://{head}{name}{ENDINGS[n % len(ENDINGS)]}{TAILS[(3 * k + j) % len(TAILS)]}", unwanted, w))
    return pd.DataFrame(rows, columns=["url", "unwanted", "word"])


def held_out_figures(labelled: pd.DataFrame, threshold: float = 0.5) -> dict[str, float]:
    """Share of unwanted URLs blocked and of others blocked, each judged by a model that saw no URL with its host's word."""
    fold = labelled["word"].map({w: k % FOLDS for k, w in enumerate(sorted(set(labelled["word"])))})
    blocked = np.zeros(len(labelled), bool)
    for k in range(FOLDS):
        host, path = zip(*map(split_url, labelled["url"][fold == k]), strict=True)
        blocked[(fold == k).to_numpy()] = fit(labelled[fold != k]).score(list(host), list(path)) >= threshold
    bad = labelled["unwanted"].to_numpy() > 0
    return {"recall": float(blocked[bad].mean()), "false_blocks": float(blocked[~bad].mean())}


def host_column(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased."""
    rest = F.coalesce(F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_column(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    rest = F.coalesce(F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))), F.lit(""))
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Label and verdict of the longest fitting rule, else null."""
    label, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.label)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        label, verdict = F.when(fits, F.lit(r.label)).otherwise(label), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return label, verdict


def grams(texts, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text index of each character n-gram of each text, its ends marked."""
    bucket, at = [], []
    marked = pa.array([f"\x02{t}\x03" if t else "" for t in texts], pa.large_string())
    for lo, _, buf, offs in slices(marked):
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        code = _BYTE[buf]
        for n in GRAMS:
            m = len(buf) - n + 1
            if m <= 0:
                continue
            h = np.zeros(m, np.uint64)
            for j in range(n):
                h += code[j : j + m] * _SLOT[j + 8 * (n % 4)]
            whole = doc[:m] == doc[n - 1 :]
            bucket.append((mix(h[whole] + np.uint64(salt)) % np.uint64(BUCKETS)).astype(np.int64))
            at.append(doc[:m][whole] + lo)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(bucket), np.concatenate(at)) if bucket else (empty, empty)


def features(host, path) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, row and value of every n-gram. Host and path are scaled apart, so that a long path says no more than a short
    one; long hosts are damped a little less than to length one, as one telling word in them is enough."""
    (hb, ha), (pb, pt) = grams(host, 1), grams(path, 2)
    of_host, of_path = (np.maximum(np.bincount(a, minlength=len(host)), 1) for a in (ha, pt))
    return np.r_[hb, pb], np.r_[ha, pt], np.r_[of_host[ha] ** -HOST_POWER, PATH_SHARE * of_path[pt] ** -0.5]


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, host, path) -> np.ndarray:
        b, a, v = features(host, path)
        z = np.bincount(a, self.weights[b] * v, minlength=len(host)) + self.bias
        return 1 / (1 + np.exp(-z))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of one URL, as the columns have them."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: min([k for k in map(tail.find, "?#") if k >= 0], default=len(tail))]


def fit(labelled: pd.DataFrame, steps: int = 400, rate: float = 2.0, ridge: float = 1e-4, bias: float = -1.0) -> UrlModel:
    """Full-batch gradient descent with balanced classes; the fixed bias lets through what shows no n-gram at all."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled URL table has {len(labelled)} rows; at most {MAX_LABELLED} are taken")
    host, path = zip(*map(split_url, labelled["url"]), strict=True)
    b, a, v = features(list(host), list(path))
    y = labelled["unwanted"].to_numpy(float)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(BUCKETS)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(a, w[b] * v, minlength=len(y)) + bias)))
        g = (p - y) * share
        w -= rate * 10 * (np.bincount(b, g[a] * v, minlength=BUCKETS) + ridge * w)
    return UrlModel(w.astype(np.float32), bias)


def judge(df: DataFrame, url: str = "url", rules=RULES, labelled: pd.DataFrame | None = None, model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """df with host, path, rule, score and verdict; the model is fitted to the labelled URLs (url, unwanted) if not given."""
    model = model or fit(labelled_urls() if labelled is None else labelled)

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(model.score(host.to_list(), path.to_list()))

    u = F.col(f"`{url}`")
    out = df.withColumns({"host": host_column(u), "path": path_column(u)})
    label, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": label, "score": score("host", "path")})
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
