"""Facts behind an answer: current values, windows, drivers, events, accuracy, processes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import blocks
from tidegauge.functions.exprs import safe_corr, slope
from tidegauge.operators import order_stats
from tidegauge.operators.answers import first_label


def window_facts(rows: DataFrame, now: float, seconds: float, by: Sequence[str] = ("signal",)) -> DataFrame:
    """Mean, least, greatest and change (last less first) over [now - seconds, now + 1]; two usable values at least."""
    part = rows.filter(F.col("ts").between(now - seconds, now + 1) & F.col("value").isNotNull())
    facts = part.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), (F.max_by("value", "ts") - F.min_by("value", "ts")).alias("change"))
    return facts.filter("n >= 2")


def time_to_levels(rows: DataFrame, levels: Sequence[float], by: Sequence[str] = ("signal",)) -> DataFrame:
    """Slope a minute, last value, and minutes until each level below it at a falling slope."""
    fit = rows.filter("value IS NOT NULL").groupBy(*by).agg((slope("value", "ts") * 60).alias("per_minute"), F.max_by("value", "ts").alias("last"))
    wait = lambda level: F.when((F.col("per_minute") < -1e-4) & (F.col("last") > level), (F.col("last") - level) / -F.col("per_minute"))
    return fit.withColumns({f"minutes_to_{level:g}": wait(level) for level in levels})


def driver_correlations(wide: DataFrame, target: str, drivers: Sequence[str], lags: Sequence[int], order: str = "k", least: int = 12, weakest: float = 0.3, top: int = 4) -> DataFrame:
    """The drivers that go with ``target``, each at its best lag in rows; weak ones are dropped, the ``top`` strongest stay."""
    dealt = blocks.looking_back(blocks.numbered(wide, (), [order]), max(lags))
    w = Window.partitionBy(blocks.BLOCK).orderBy("_n")
    shifted = dealt.select("_own", target, *[F.lag(d, k).over(w).alias(f"{d}_{k}") if k else F.col(d).alias(f"{d}_0") for d in drivers for k in lags]).filter("_own")
    both = lambda c: F.count_if(F.col(target).isNotNull() & F.col(c).isNotNull())
    cells = [(d, k, f"{d}_{k}") for d in drivers for k in lags]
    one = shifted.agg(*[F.struct(both(c).alias("n"), safe_corr(target, c).alias("r")).alias(c) for _, _, c in cells])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(d).alias("driver"), F.lit(k).alias("lag"), F.col(c)["n"].alias("n"), F.col(c)["r"].alias("r")) for d, k, c in cells])).alias("x")).select("x.*")
    usable = rows.filter((F.col("n") >= least) & F.col("r").isNotNull())
    best = usable.groupBy("driver").agg(F.max_by(F.struct("lag", "n", "r"), F.struct(F.round(F.abs("r"), 9), -F.col("lag"))).alias("b")).select("driver", "b.*")
    return best.filter(F.abs("r") >= weakest).orderBy(F.desc(F.abs("r")), "driver").limit(top)


def newest_events(first: DataFrame, second: DataFrame, each: int, top: int, order: Sequence[str]) -> DataFrame:
    """The ``top`` newest of the ``each`` newest rows of two logs."""
    newest = lambda df, n: df.orderBy(*[F.desc(c) for c in order]).limit(n)
    return newest(newest(first, each).unionByName(newest(second, each)), top)


def quantiles(rows: DataFrame, value: str, by: Sequence[str], least: int = 12) -> DataFrame:
    """Median, 10th and 90th percentile by group; ``least`` rows at least."""
    q = order_stats.quantiles(rows, by, value, [0.1, 0.5, 0.9], order_stats.FEW).withColumnRenamed("quantiles", "q").filter(F.col("n") >= least)
    return q.select(*by, "n", F.col("q")[0].alias("p10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p90"))


def best_open_forecast(predictions: DataFrame, first: str, by: Sequence[str] = ("signal", "horizon")) -> DataFrame:
    """Of each scope's unresolved forecasts the one of arm ``first``, else the newest."""
    w = Window.partitionBy(*by).orderBy((F.col("arm") == first).desc(), F.desc("ts"), "arm")
    return predictions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def regime_spells(rows: DataFrame, regime: str = "regime", order: str = "k", by: Sequence[str] = (), span: float = blocks.SPAN) -> DataFrame:
    """(regime, since, until, ticks) of each unbroken spell. Ticks are dealt into blocks of ``span`` of ``order``."""
    w = Window.partitionBy(*by, blocks.BLOCK).orderBy(order)
    carried = blocks.with_earlier(blocks.dealt(rows, order, span), by, last={"_was": F.max_by(regime, order)})
    fresh = carried.withColumn("_fresh", F.coalesce((F.col(regime) != F.coalesce(F.lag(regime).over(w), "_was")).cast("long"), F.lit(1)))
    counted = blocks.with_earlier(fresh.drop("_was"), by, total={"_count": F.sum("_fresh")})
    spells = counted.withColumn("_spell", F.col("_count") + F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return spells.groupBy(*by, "_spell", regime).agg(F.min(order).alias("since"), F.max(order).alias("until"), F.count("*").alias("ticks")).drop("_spell")


#: Process categories in the order they are tried, with the parts of a lower-cased name that give them.
CATEGORIES = (
    ("build", (
        "cc1", "cc1plus", "gcc", "g++", "clang", "clang++", "ld", "lld", "rustc", "cargo", "ninja", "make", "cmake", "javac", "kotlinc", "scalac", "tsc", "webpack", "esbuild", "rollup", "vite",
        "gradle", "mvn", "bazel", "swiftc", "conda-build", "pip", "setup.py", "meson", "sccache", "ccache")),
    ("browser", ("firefox", "chrome", "chromium", "brave", "msedge", "safari", "webkit", "vivaldi", "opera", "librewolf")),
    ("media", ("vlc", "mpv", "ffmpeg", "obs", "spotify", "handbrake", "gstreamer", "pipewire", "wireplumber", "totem", "celluloid")),
    ("ml", ("python3", "python", "jupyter", "ollama", "llama", "torchrun", "tensorboard", "vllm", "ray")),
    ("container", ("docker", "containerd", "podman", "crio", "qemu", "virtqemud", "libvirt")),
    ("editor", ("code", "codium", "cursor", "nvim", "vim", "emacs", "idea", "pycharm", "zed", "sublime")),
    ("system", ("systemd", "kworker", "dbus", "journald", "packagekit", "dnf", "rpm", "apt", "gnome-shell", "cosmic", "kwin", "plasmashell", "Xorg", "wayland")),
)


def category(name: Column | str, categories: Sequence[tuple[str, Sequence[str]]] = CATEGORIES) -> Column:
    """The first category with a part of the lower-cased name; null for none."""
    return first_label(F.lower(F.col(name) if isinstance(name, str) else name), categories, None)


def attribution(rows: DataFrame, at: Sequence[str], name: str = "name", load: str = "load") -> DataFrame:
    """Load by category, the greatest single load, and the share of the three greatest, of each tick."""
    w = Window.partitionBy(*at).orderBy(F.desc(load), name)
    ranked = rows.withColumns({"_n": F.row_number().over(w), "_c": category(name)})
    total = F.sum(load)
    sums = [F.sum(F.when(F.col("_c") == c, F.col(load)).otherwise(0.0)).alias(f"load_{c}") for c, _ in CATEGORIES]
    return ranked.groupBy(*at).agg(*sums, F.max(load).alias("top1"), F.try_divide(F.sum(F.when(F.col("_n") <= 3, F.col(load))), total).alias("concentration"))


#: Signals that an answer looks at first.
PRIORITY = ("cpu.util_pct", "mem.used_pct", "battery.percent", "battery.plugged", "gpu.util_pct", "thermal.cpu_c", "battery.power_w", "disk.busy_pct")


def current_facts(rows: DataFrame, now: float, priority: Sequence[str] = PRIORITY, focus: str | None = None) -> DataFrame:
    """(place, signal, value, ts, age) of the newest tick's usable values, those of ``priority`` in its order, a focus outside it first."""
    wanted = [focus, *priority] if focus and focus not in priority else list(priority)
    # The newest tick by an aggregate, which is one row; its readings follow by a join on its time.
    newest = rows.agg(F.max("ts").alias("ts"))
    found = rows.join(F.broadcast(newest), "ts").filter(F.col("signal").isin(wanted) & F.col("value").isNotNull())
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col("signal")).cast("int")
    return found.select(place.alias("place"), "signal", "value", "ts", (F.lit(now) - F.col("ts")).alias("age"))


def accuracy_facts(scored: DataFrame, now: float, seconds: float = 7200.0, least: int = 10, focus: str | None = None, reference: str = "persistence", by: Sequence[str] = ("signal", "horizon")) -> DataFrame:
    """(arm, by, n, mae, skill) of forecasts that came due in the last ``seconds``, for groups of ``least`` or more; skill against ``reference``."""
    part = scored.filter(F.col("ts_target").between(now - seconds, now))
    part = part.filter(F.col("signal") == focus) if focus else part
    maes = part.groupBy("arm", *by).agg(F.count("*").alias("n"), F.avg("abs_error").alias("mae"))
    reference_ = maes.filter(F.col("arm") == reference).select(*by, F.col("mae").alias("_ref"))
    joined = maes.join(reference_, list(by), "left").filter(F.col("n") >= least)
    return joined.select("arm", *by, "n", "mae", F.when(F.col("_ref") > 0, 1 - F.try_divide(F.col("mae"), F.col("_ref"))).alias("skill"))


def user_context(feedback: DataFrame, scanned: int = 60, limit: int = 8) -> DataFrame:
    """(id, ts, line) of the newest labels and notes with text, among the ``scanned`` newest rows of feedback (id, ts, kind, text)."""
    newest = feedback.orderBy(F.desc("ts"), F.desc("id")).limit(scanned)
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    said = newest.filter(F.col("kind").isin("label", "note") & (text != ""))
    line = F.concat(F.when(F.col("kind") == "label", 'User labels this behaviour: "').otherwise('User note: "'), text, F.lit('"'))
    return said.select("id", "ts", line.alias("line")).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def evidence_pack(now: float, intent: Column, **parts: DataFrame) -> DataFrame:
    """One row: now, intent, and for each part an array of its rows. Parts are facts of one answer, each bounded by its own operator."""
    pack = None
    for name, rows in parts.items():
        one = rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias(name))
        pack = one if pack is None else pack.join(F.broadcast(one), how="cross")
    return pack.select(F.lit(now).alias("now"), intent.alias("intent"), *parts)
