"""Contributors."""
from pyspark.sql import functions as F

from ringside.checks.registry import check
from ringside.operators import contributors, spatial

c = F.col


def _told(t):
    return contributors.contributions(t.shots, t.reviews.select("id", "author"))


@check("u1_photos_and_reviews", "SELECT author, kind, id FROM contribs", ["contribs"])
def _(t):
    return _told(t)


NAMED = "SELECT DISTINCT author FROM names"
CONTRIB_NAMED = "SELECT DISTINCT author FROM contribs"


@check("j9_name_reconciliation", "SELECT name, canonical FROM canon", ["names", "named", "canon"], named=NAMED)
def _(t):
    return contributors.canonical_names(t.names)


BOARD = """SELECT canonical AS name, count(DISTINCT id) AS sites, count(*) FILTER (WHERE kind = 'photo') AS photos, count(*) FILTER (WHERE kind = 'review') AS reviews,
   row_number() OVER (ORDER BY count(DISTINCT id) DESC, count(*) FILTER (WHERE kind = 'photo') DESC, count(*) FILTER (WHERE kind = 'review') DESC, canonical) AS rank
   FROM contribs JOIN canon ON canon.name = contribs.author GROUP BY canonical QUALIFY rank <= 200"""
BOARD_NEEDS = ["contribs", "named", "canon"]


def _board(t):
    told = _told(t)
    return contributors.board(told, contributors.canonical_names(told))


@check("a11_contributor_board", f"SELECT name, sites, photos, reviews FROM ({BOARD})", BOARD_NEEDS, named=CONTRIB_NAMED)
def _(t):
    return _board(t).drop("rank")


@check("w9_contributor_rank", f"SELECT name, rank FROM ({BOARD})", BOARD_NEEDS, named=CONTRIB_NAMED)
def _(t):
    return _board(t).select("name", "rank")


DATES = """SELECT s.id, coalesce(h.added, f.mtime) AS date FROM sites_raw s JOIN stamps f ON f.id = s.id LEFT JOIN (SELECT id, min(date) AS added FROM history WHERE status = 'A' GROUP BY id) h ON h.id = s.id"""


@check("s11_contribution_dates", DATES, ["sites_raw", "history", "stamps"])
def _(t):
    return contributors.contribution_dates(t.sites_raw, t.history, t.stamps)


LATEST = f"SELECT id, date FROM ({DATES}) WHERE id IN (SELECT id FROM sites_raw WHERE n_photos > 0) ORDER BY date DESC, id LIMIT 200"
LATEST_NEEDS = ["sites_raw", "history", "stamps"]


def _latest(t):
    dates = contributors.contribution_dates(t.sites_raw, t.history, t.stamps)
    return contributors.latest(t.sites_raw.where("n_photos > 0"), dates)


@check("a12_latest_contributions", LATEST, LATEST_NEEDS)
def _(t):
    return _latest(t)


FORMS = """SELECT lower(array_to_string(string_split(name, ' ')[:n], ' ')) AS form, arg_min(name, ROW(n < len(string_split(name, ' ')), rank)) AS canon FROM (SELECT *, unnest(range(1, len(string_split(name, ' ')) + 1)) AS n FROM board) GROUP BY 1"""


@check("j18_latest_with_authors", f"SELECT DISTINCT l.id, l.date, coalesce(f.canon, k.author) AS author FROM ({LATEST}) l JOIN contribs k ON k.id = l.id LEFT JOIN ({FORMS}) f ON f.form = lower(k.author)",
       LATEST_NEEDS + BOARD_NEEDS + ["board"], named=CONTRIB_NAMED, board=BOARD)
def _(t):
    return contributors.latest_authors(_latest(t), _told(t), _board(t))


FIRST_SAMPLES = "SELECT dep, seq, year FROM samples QUALIFY row_number() OVER (PARTITION BY dep ORDER BY seq) <= 3"


@check("w4_first_three_samples", FIRST_SAMPLES, ["samples"])
def _(t):
    return spatial.keep_first(t.samples, ["dep"], ["seq"], 3).select("dep", "seq", "year")


@check("a13_imagery_year", f"SELECT dep, min(year) AS year FROM ({FIRST_SAMPLES}) GROUP BY dep HAVING count(DISTINCT year) = 1", ["samples"])
def _(t):
    return contributors.imagery_years(t.samples)
