"""DuckDB twins of the registered queries, composed from named common table expressions."""

from __future__ import annotations

import re

from revmatch.functions.stopwords import default_stop_words
from revmatch.params import RunOptions, ScoringParams

PARAMS, OPTIONS = ScoringParams(), RunOptions()


def words_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def r9(x: str) -> str:
    return f"(floor(({x}) * 1e9 + 0.5) / 1e9)"


def isum(x: str, scale: str) -> str:
    """Order-free sum of doubles."""
    return f"(sum(cast(floor(({x}) * {scale} + 0.5) as hugeint))::double / {scale})"


def away(x: str) -> str:
    return f"cast(sign({r9(x)}) * floor(abs({r9(x)}) + 0.5) as int)"


def clean(t: str) -> str:
    return f"lower(replace(replace({t}, '-' || chr(10), ''), chr(10), ' '))"


def tokens(t: str) -> str:
    return rf"list_filter(string_split_regex({clean(t)}, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-z]{{2,}}$'))"


SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '{SPACE}+', ' ', 'g'))"


def terms(source: str, keys: str, text: str) -> str:
    """Term counts of a text column: unigrams and bigrams after stop words."""
    kept = f"list_filter({tokens(text)}, lambda x: not list_contains(words, x))"
    return f"""select {keys}, term, count(*) as tf from (
      select {keys}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term
      from (select {keys}, {kept} as w from {source} cross join stop)) group by {keys}, term"""


def quantile(source: str, keys: str, value: str, out: str = "q") -> str:
    return (f"select *, ((rank() over (partition by {keys} order by {value}) - 1) "
            f"+ (count(*) over (partition by {keys}, {value}) - 1) / 2.0::double + 0.5::double) "
            f"/ count(*) over (partition by {keys}) as {out} from {source}")


LETTERS = "aeinorst"


def letters(t: str) -> str:
    return "[" + ", ".join(f"(length({t}) - length(replace({t}, '{c}', '')))::double" for c in LETTERS) + "]"


def bids_chain(prefix: str, scored: str, frac: float = OPTIONS.positive_frac) -> dict[str, tuple[str, list[str]]]:
    """q -> value -> threshold -> bid for a scored table."""
    p = PARAMS
    k = "round_id, reviewer_id"
    sem = f"greatest(-{p.ref_max}::double, least({p.ref_max}::double, sign(2 * q - 1) * pow(abs(2 * q - 1), {p.exponent}::double) * {p.ref_max}::double))"
    value = r9(f"greatest(-{p.ref_max}::double, least({p.ref_max}::double, {1 - p.interest_weight!r}::double * sem + {p.interest_weight!r}::double * topic_base))")
    idx = f"least(greatest(cast(round_even({1.0 - frac!r}::double * n, 0) as bigint), 0), n - 1)"
    up = away(f"(value - tau) / coalesce(nullif(v_max - tau, 0), 1.0::double) * {p.bid_max - 1}")
    down = away(f"(value - tau) / coalesce(nullif(tau - v_min, 0), 1.0::double) * {p.bid_max}")
    return {
        f"{prefix}_q": (quantile(scored, k, "sim"), [scored]),
        f"{prefix}_v": (f"select *, {value} as value from (select *, {sem} as sem from {prefix}_q)", [f"{prefix}_q"]),
        f"{prefix}_t": (f"""select {k}, max(case when spot = {idx} then value end) as tau, min(value) as v_min, max(value) as v_max from (
            select {k}, value, row_number() over (partition by {k} order by value) - 1 as spot, count(*) over (partition by {k}) as n
            from {prefix}_v) group by {k}""", [f"{prefix}_v"]),
        f"{prefix}_bids": (f"""select *, case when value > tau then greatest(1, least({p.bid_max}, 1 + {up}))
            else greatest(-{p.bid_max}, least(0, {down})) end as bid from {prefix}_v join {prefix}_t using ({k})""",
                           [f"{prefix}_v", f"{prefix}_t"]),
    }


AFFINITY = "coalesce((select i.interest from interests i where i.reviewer_id = r.reviewer_id and i.topic = t.topic), 0) * 10"
TOPN = f"greatest(1, least(greatest(150, cast(ceil({3.0 * OPTIONS.positive_frac!r}::double * n_subs) as bigint)), n_subs))"

CTES: dict[str, tuple[str, list[str]]] = {
    "stop": (f"select {words_list(default_stop_words())} as words", []),
    "subs": ("""select doc_id as paper, case when doc_id % 3 = 0 then 'B' else 'A' end as round_id,
        split_part(text, chr(10), 1) as title, substr(text, length(split_part(text, chr(10), 1)) + 2) as abstract,
        lang, source from documents""", []),
    "sub_texts": ("select round_id, paper, title || '. ' || abstract as text from subs", ["subs"]),
    "papers": ("""select r.round_id, item_id % 5 as reviewer_id, item_id as paper_key, text
        from benchmark cross join (values ('A'), ('B')) r(round_id)""", []),
    "roster": ("""select round_id, reviewer_id, count(distinct paper_key) as n_papers from papers
        group by round_id, reviewer_id having count(distinct paper_key) >= 5""", ["papers"]),
    "pools": ("select round_id, count(*) as n_subs from subs group by round_id", ["subs"]),
    "interests": ("""select reviewer_id, topic, cast((base + 2 + reviewer_id) % 5 - 2 as int) as interest from (
        select distinct t as topic, case t when 'en' then 2 when 'fr' then 1 when 'de' then 0 when 'es' then -1
          else cast(substr(t, 4) as int) % 5 - 2 end as base
        from (select lang as t from documents union all select source from documents where source <> 'src19'))
        cross join range(0, 5) r(reviewer_id)""", []),
    "tags": ("""select round_id, paper, 0 as tag_no, lang as topic from subs
        union all select round_id, paper, 1, source from subs""", ["subs"]),
    "pool": ("""select p.round_id, r.reviewer_id, p.paper, n.n_subs, r.n_papers from subs p
        join roster r on p.round_id = r.round_id join pools n on n.round_id = p.round_id""", ["subs", "roster", "pools"]),
    "tag_affinity": ("""select p.round_id, p.reviewer_id, p.paper, t.tag_no, t.topic, coalesce(i.interest, 0) * 10 as affinity
        from pool p join tags t on p.round_id = t.round_id and p.paper = t.paper
        left join interests i on i.reviewer_id = p.reviewer_id and i.topic = t.topic""", ["pool", "tags", "interests"]),
    "topic_bases": ("""select round_id, reviewer_id, paper,
        0.6::double * max(affinity) + 0.4::double * (sum(affinity)::double / count(*)) as topic_base
        from tag_affinity group by round_id, reviewer_id, paper""", ["tag_affinity"]),
    "sub_tf": (terms("sub_texts", "round_id, paper", "text"), ["sub_texts", "stop"]),
    "paper_tf": (terms("papers", "round_id, reviewer_id, paper_key", "text"), ["papers", "stop"]),
    "vocab": ("""select round_id, term, df, ln((1 + n_subs) / (1 + df)::double) + 1 as idf from (
        select round_id, term, count(*) as df from sub_tf group by round_id, term) join pools using (round_id)
        where df >= 2 and df <= 0.3::double * n_subs""", ["sub_tf", "pools"]),
    "sub_w": ("select round_id, paper, term, (1 + ln(tf)) * idf as w from sub_tf join vocab using (round_id, term)", ["sub_tf", "vocab"]),
    "sub_norm": (f"select round_id, paper, sqrt({isum('w * w', '1e10')}) as norm from sub_w group by round_id, paper", ["sub_w"]),
    "paper_raw": ("""select round_id, reviewer_id, paper_key, term, (1 + ln(tf)) * idf as w
        from paper_tf join vocab using (round_id, term)""", ["paper_tf", "vocab"]),
    "paper_w": (f"""select round_id, reviewer_id, paper_key, term, w / norm as w from paper_raw join (
        select round_id, reviewer_id, paper_key, sqrt({isum('w * w', '1e10')}) as norm from paper_raw
        group by round_id, reviewer_id, paper_key) using (round_id, reviewer_id, paper_key)""", ["paper_raw"]),
    "cosines": (f"""select round_id, reviewer_id, paper, paper_key, {r9('dot / norm')} as sim from (
        select s.round_id, p.reviewer_id, s.paper, p.paper_key, {isum('s.w * p.w', '1e12')} as dot
        from sub_w s join paper_w p on s.round_id = p.round_id and s.term = p.term
        group by s.round_id, p.reviewer_id, s.paper, p.paper_key) join sub_norm using (round_id, paper)""",
                ["sub_w", "paper_w", "sub_norm"]),
    "top3": (f"""select round_id, reviewer_id, paper, sum(sim) as total from (
        select *, row_number() over (partition by round_id, reviewer_id, paper order by sim desc) as place from cosines)
        where place <= 3 group by round_id, reviewer_id, paper""", ["cosines"]),
    "scored": (f"""select p.round_id, p.reviewer_id, p.paper, p.n_subs, p.n_papers, b.topic_base,
        {r9('coalesce(t.total, 0) / least(3, p.n_papers)')} as sim from pool p
        join topic_bases b using (round_id, reviewer_id, paper) left join top3 t using (round_id, reviewer_id, paper)""",
               ["pool", "topic_bases", "top3"]),
    **bids_chain("tf", "scored"),
    "short": (f"""select *, row_number() over (partition by round_id, reviewer_id order by sim desc, paper) <= {TOPN} as is_candidate
        from scored""", ["scored"]),
    "sub_tokens": (f"select round_id, paper, list_distinct({tokens('text')}) as b from sub_texts", ["sub_texts"]),
    "paper_tokens": (f"select round_id, reviewer_id, paper_key, list_distinct({tokens(collapse('text'))}) as a from papers", ["papers"]),
    "pairs": ("""select c.round_id, c.reviewer_id, c.paper, p.paper_key, c.n_papers, a, b from short c
        join paper_tokens p on p.round_id = c.round_id and p.reviewer_id = c.reviewer_id
        join sub_tokens s on s.round_id = c.round_id and s.paper = c.paper where is_candidate""",
              ["short", "paper_tokens", "sub_tokens"]),
    "pair_scores": (f"""select round_id, reviewer_id, paper, paper_key, n_papers,
        {r9('coalesce(len(list_intersect(a, b))::double / nullif(len(a) + len(b) - len(list_intersect(a, b)), 0), 0)')} as pair_sim
        from pairs""", ["pairs"]),
    "pair_means": (f"""select round_id, reviewer_id, paper, {r9('sum(pair_sim) / least(3, max(n_papers))')} as pair_mean from (
        select *, row_number() over (partition by round_id, reviewer_id, paper order by pair_sim desc) as place from pair_scores)
        where place <= 3 group by round_id, reviewer_id, paper""", ["pair_scores"]),
    "joined_bands": ("""select s.*, m.pair_mean, case when is_candidate then m.pair_mean else s.sim end as score
        from short s left join pair_means m using (round_id, reviewer_id, paper)""", ["short", "pair_means"]),
    "band_q": (quantile("joined_bands", "round_id, reviewer_id, is_candidate", "score", "bq"), ["joined_bands"]),
    "bands": ("""select round_id, reviewer_id, paper, n_subs, n_papers, topic_base, is_candidate, pair_mean, sim as tfidf_sim,
        case when is_candidate then 1 + bq else bq end as sim from band_q""", ["band_q"]),
    **bids_chain("rr", "bands"),
    "emb": ("select *, row_number() over (partition by label order by vec_id) as r from embeddings", []),
    "emb_papers": ("""select round_id, label::bigint as reviewer_id, vec_id as paper_key, embedding::double[] as vec from emb
        cross join (values ('A'), ('B')) x(round_id) where r <= 5""", ["emb"]),
    "emb_subs": ("""select case when vec_id % 3 = 0 then 'B' else 'A' end as round_id, vec_id as paper, embedding::double[] as vec
        from emb where r > 5""", ["emb"]),
    "emb_roster": ("""select round_id, reviewer_id, count(*) as n_papers from emb_papers group by round_id, reviewer_id
        having count(*) >= 5""", ["emb_papers"]),
    "emb_cos": (f"""select s.round_id, p.reviewer_id, s.paper, p.paper_key,
        {r9('coalesce(list_cosine_similarity(s.vec, p.vec), 0)')} as sim from emb_subs s
        join emb_papers p using (round_id) join emb_roster using (round_id, reviewer_id)""", ["emb_subs", "emb_papers", "emb_roster"]),
    "emb_scored": (f"""select round_id, reviewer_id, paper, 0.0::double as topic_base, {r9('sum(sim) / least(3, max(n)) ')} as sim from (
        select *, count(*) over (partition by round_id, reviewer_id, paper) as n,
        row_number() over (partition by round_id, reviewer_id, paper order by sim desc) as place from emb_cos)
        where place <= 3 group by round_id, reviewer_id, paper""", ["emb_cos"]),
    **bids_chain("em", "emb_scored"),
    # vectors of letter counts, from the texts
    "letter_subs": (f"select round_id, paper, {letters('t')} as vec from (select round_id, paper, title || '[SEP]' || abstract as t from subs)", ["subs"]),
    "letter_papers": (f"select round_id, reviewer_id, paper_key, {letters('t')} as vec from (select round_id, reviewer_id, paper_key, {collapse('text')} as t from papers)", ["papers"]),
    "letter_cos": (f"""select s.round_id, p.reviewer_id, s.paper, p.paper_key,
        {r9('case when list_sum(s.vec) = 0 or list_sum(p.vec) = 0 then 0 else list_cosine_similarity(s.vec, p.vec) end')} as sim
        from letter_subs s join letter_papers p using (round_id) join roster using (round_id, reviewer_id)""", ["letter_subs", "letter_papers", "roster"]),
    "letter_scored": (f"""select round_id, reviewer_id, paper, topic_base, {r9('sum(sim) / least(3, max(n))')} as sim from (
        select *, count(*) over (partition by round_id, reviewer_id, paper) as n,
        row_number() over (partition by round_id, reviewer_id, paper order by sim desc) as place from letter_cos)
        join topic_bases using (round_id, reviewer_id, paper) where place <= 3 group by round_id, reviewer_id, paper, topic_base""", ["letter_cos", "topic_bases"]),
    **bids_chain("le", "letter_scored"),
}


def _closure(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for needed in CTES[name][1]:
            visit(needed)
        order.append(name)

    for name in names:
        visit(name)
    return order


def sql(select: str) -> str:
    """The select with every table expression it names, in order."""
    used = [name for name in CTES if re.search(rf"\b(from|join)\s+{name}\b", select)]
    parts = ",\n".join(f"{name} as ({CTES[name][0]})" for name in _closure(used))
    return f"with {parts}\n{select}" if parts else select
