"""DuckDB SQL that equals some of the corpus queries, written from their contracts and not from their code."""

_FOLD = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_ITEM_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_HOST_RULES = {"few_words": "n_words < 10", "repeats": "5 * n_repeat_words > n_words", "symbols": "n_symbols * 10 > n_words", "dup_lines": "n_dup_lines * 10 > n_lines * 3"}

op1_quality_rules = rf"""
with d as (select doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), {_WORD}) w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d where len(w) >= 5)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) k from g) where k > 1),
rep as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 5)) p from twice) group by 1),
dup as (select doc_id, count(*) - count(distinct line) n, count(*) lines from (select doc_id, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
f as (select d.doc_id, source, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
  coalesce(dup.n, 0)::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words, coalesce(dup.lines, 0)::bigint n_lines from d left join dup using (doc_id) left join rep using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from f),
h as (select source, count(*) n, [{", ".join(f"count(*) filter ({x})" for x in _HOST_RULES.values())}] ks from b group by 1),
u as (select source, n, rule, ks[rule] k, ks[rule] / n rate, (n >= 2)::int counts from h, (select unnest(range(1, {len(_HOST_RULES) + 1})) rule)),
o as (select source, rule, n, k, sum(counts) over r - counts others, sum(counts * rate) over r - counts * rate rates, sum(counts * rate * rate) over r - counts * rate * rate squares from u window r as (partition by rule)),
m as (select *, rates / others mean, squares / others - (rates / others) * (rates / others) var from o),
i as (select *, case when others < 2 then 0.5::double else least(greatest(mean, 0.001::double), 0.999::double) end mid from m),
st as (select *, case when others < 2 then 2 when var <= 1e-12 or mean <= 0 or mean >= 1 then 100 else greatest(1e-3, mid * (1 - mid) / var - 1) end::double strength from i),
sh as (select *, round((k + mid * strength) / (n + strength), 9) shrunk from st),
r as (select source, {", ".join(f"max(shrunk) filter (rule = {k}) rate_{x}" for k, x in enumerate(_HOST_RULES, 1))},
  coalesce(string_agg({list(_HOST_RULES)}[rule], ',' order by rule) filter (shrunk > 0.25 and shrunk > mid + 3 * sqrt(mid * (1 - mid) / (strength + 1))), '') host_failed from sh group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and host_failed = '' kept, n_lines, {", ".join(f"rate_{x}" for x in _HOST_RULES)}, host_failed from b join r on b.source is not distinct from r.source"""

# crc32 bit by bit: each byte is followed by seven zeros, and every step takes one bit of the state
op2_sharding = """
with d as (select doc_id, coalesce(text, '') t, octet_length(encode(coalesce(text, ''))) + 1 size from documents),
b as (select *, flatten(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: [('0x' || x)::bigint, 0, 0, 0, 0, 0, 0, 0])) bits from d),
c as (select doc_id, size, xor(list_reduce(bits, lambda s, x: xor(xor(s, x) >> 1, (xor(s, x) & 1) * 3988292384), 4294967295::bigint), 4294967295::bigint) text_crc32 from b),
p as (select *, sum(size) over (order by doc_id) - size byte_start, sum(size) over () total from c),
s as (select *, least(7, ((byte_start * 2 + size) * 8) // (2 * total))::int shard from p)
select doc_id, size::bigint size, text_crc32, 'bytes' law, shard, row_number() over (partition by shard order by doc_id) - 1 slot, null::int grown_shard, byte_start::bigint byte_start from s"""

op4_ngram_jaccard_join = rf"""
with recursive d as (select doc_id, regexp_extract_all({_FOLD.format(t="coalesce(text, '')")}, {_WORD}) w from documents),
s as (select distinct doc_id, g from (
  select doc_id, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d where len(w) >= 5)
  union all select doc_id, array_to_string(w, ' ') || ' .' from d where len(w) between 1 and 4)),
n as (select doc_id, count(*) n from s group by 1),
again as (select g from s group by 1 having count(*) > 1),
e as (select x.doc_id a, y.doc_id b, count(*) k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id where x.g in (select g from again) group by 1, 2),
l as (select a, b from e join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 75 * (na.n + nb.n - k)),
r as (select doc_id node, doc_id reached from documents union select r.node, l.b from r join l on l.a = r.reached),
c as (select doc_id, md5(string_agg(g, '|' order by g)) h from s group by 1),
z as (select h, count(*) k from c group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, (select min(reached) from r where node = d.doc_id) component_id, coalesce(z.k, 1)::bigint class_size, (select count(*) from l where l.a = d.doc_id) n_links
from d left join n using (doc_id) left join c using (doc_id) left join z using (h)"""

op5_benchmark_decontamination = rf"""
with d as (select doc_id, regexp_extract_all({_FOLD.format(t="coalesce(text, '')")}, {_ITEM_WORD}) w from documents),
i as (select item_id, least(13, len(w)) k, w from (select item_id, regexp_extract_all({_FOLD.format(t="text")}, {_ITEM_WORD}) w from benchmark where text is not null and item_id is not null) where len(w) > 0),
iw as (select distinct item_id::varchar item_id, k, array_to_string(w[p:p + k - 1], ' ') g from (select *, unnest(range(1, len(w) - k + 2)) p from i)),
ks as (select distinct k from iw),
dw as (select doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') g from (select doc_id, k, w, unnest(range(1, len(w) - k + 2)) p from d, ks where len(w) >= k)),
m as (select doc_id, item_id, p, dw.k from dw join iw on dw.k = iw.k and dw.g = iw.g),
h as (select doc_id, count(distinct q) n from (select doc_id, unnest(range(p, p + k)) q from m) group by 1),
it as (select doc_id, count(*) n, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id from m) group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(h.n, 0)::bigint n_hit, coalesce(it.n, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(h.n, 0) > 0 and 20 * coalesce(h.n, 0) >= len(w) contaminated
from d left join h using (doc_id) left join it using (doc_id)"""


def _secrets() -> str:
    assign = """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?[A-Za-z0-9+/_.=-]+"""
    value = """["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)$"""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = (digits + "abcdef", digits + "ABCDEF", upper + "234567", digits + lower, digits + upper, upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_")

    def spans(k: int, pattern: str) -> str:
        return f"""select doc_id, {k} k, x, (sum(gap + length(x)) over (partition by doc_id order by i) - length(x))::bigint s, sum(gap + length(x)) over (partition by doc_id order by i)::bigint e
  from (select doc_id, i, length(pieces[i]) gap, found[i] x from (select doc_id, found, regexp_split_to_array(t, '{pattern}') pieces, unnest(range(1, len(found) + 1)) i
  from (select doc_id, t, regexp_extract_all(t, '{pattern}', 0) found from d) where len(found) > 0))"""

    two = lambda z: f"least(1, 2 / (1 + exp(0.07056 * pow(abs({z}), 3) + 1.5976 * abs({z}))))"
    up = lambda z: f"(1 / (1 + exp(0.07056 * pow({z}, 3) + 1.5976 * ({z}))))"
    excess = lambda chi, f: f"least(1, 2 * {up(f'greatest(0, (pow({chi} / ({f}), 1.0 / 3) - (1 - 2.0 / (9 * ({f})))) / sqrt(2.0 / (9 * ({f}))))')})"
    alphabet = "case " + " ".join(f"when translate(x, '{a}', '') = '' then '{a}'" for a in alphabets) + " end"
    kind = lambda c: f"case when {c} between '0' and '9' then 0 when {c} between 'a' and 'z' then 1 when {c} between 'A' and 'Z' then 2 else 3 end"
    band = "case when n < 24 then 0 when n < 32 then 1 when n < 48 then 2 when n < 64 then 3 when n < 128 then 4 else 5 end"
    steps = lambda p: f"floor(least(60, -log10(greatest({p}, 1e-300))) * 4 + 1e-9)::int"
    z = "((changes - 0.5 - (n - 1) * rate) / sqrt((n - 1) * (rate * (1 - rate))))"
    var = "(2 * lo * (n - lo) * (2 * lo * (n - lo) - n) / (n * n * (n - 1)))"
    # the largest share of the most extreme p values, in each band, that keeps false discoveries at 1 in 100
    least = lambda of, step: f"""select band, min(step) least_step from (select band, {step} step, sum(count(*)) over (partition by band order by {step} desc) so_far, sum(count(*)) over (partition by band) n from {of} group by 1, 2)
  where pow(10, -step / 4.0::double) <= so_far * 0.01 / n group by 1"""  # noqa: E731
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
a as ({spans(0, assign)}), b as ({spans(1, "AKIA[A-Z0-9]{16,}")}), h as ({spans(2, "[0-9a-f]{24,}")}), c as ({spans(3, "[A-Za-z0-9+/_-]{20,}={0,2}")}),
base as (select * from a where length(regexp_extract(x, '{value}', 1)) >= 6 union all select * from b union all select * from h),
free as (select row_number() over () id, doc_id, s, e, rtrim(x, '=') x from c where not exists (select 1 from base where base.doc_id = c.doc_id and base.s < c.e and base.e > c.s)),
al as (select *, {alphabet} al, length(x)::double n from free), ok as (select *, length(al)::double m from al where al is not null),
ch as (select id, n, m, al, i, x[i] ch, {kind('x[i]')} cls, instr(al, x[i]) - 0.5 - m / 2 v from (select *, unnest(range(1, length(x) + 1)) i from ok)),
nb as (select *, lead(v) over (partition by id order by i) nv, lead(cls) over (partition by id order by i) nc from ch),
sq as (select id, sum(k * k)::double sq from (select id, ch, count(*) k from ch group by 1, 2) group by 1),
size as (select al, cls, count(*)::double w from (select al, {kind('q')} cls from (select al, unnest(string_split(al, '')) q from (select distinct al from ok))) group by 1, 2),
cl as (select ok.id, count(*) cells, sum(pow(coalesce(k, 0) - n * w / m, 2) / (n * w / m)) chi_class from ok join size using (al) left join (select id, cls, count(*)::double k from ch group by 1, 2) q on q.id = ok.id and q.cls = size.cls group by 1),
st as (select id, sum(case when v < 0 then 1 else 0 end)::double lo, 1 + sum(case when (v < 0) <> (nv < 0) then 1 else 0 end)::double runs, sum(v * nv) serial, sum(case when cls <> nc then 1 else 0 end)::double changes from nb group by 1),
t as (select ok.id, doc_id, s, e, n, changes, {band} band, least(1, 4 * least(
  case when lo * (n - lo) < 1 then pow(2.0::double, 1 - n) when {var} <= 0 then 1 else {two(f'((runs - (1 + 2 * lo * (n - lo) / n)) / sqrt({var}))')} end,
  {excess('(m / n * sq - n)', '(m - 1)')}, case when cells < 2 then 1 else {excess('chi_class', '(cells - 1)')} end, {two('(serial / ((m * m - 1) / 12 * sqrt(n - 1)))')})) random_p
  from ok join sq using (id) join cl using (id) join st using (id)),
r as (select *, {steps('random_p')} random_step from t), rl as ({least('r', 'random_step')}),
told as (select r.*, coalesce(random_step >= least_step, false) not_random from r left join rl using (band)),
q as (select coalesce(least(0.5, greatest(0.01, sum(changes) / sum(n - 1))), 0.08) rate from told where not_random),
p as (select told.*, {steps(f'case when {z} <= 0 then 1 else {up(z)} end')} text_step from told, q), pl as ({least('p', 'text_step')}),
every as (select doc_id, s, k, e from base union all select doc_id, s, 3, e from p join pl using (band) where text_step >= least_step and not not_random),
o as (select doc_id, count(*) filter (k = 0) n_assign, count(*) filter (k = 1) n_access, count(*) filter (k = 2) n_hex, count(*) filter (k = 3) n_random,
  string_agg(['assign', 'access', 'hex', 'random'][k + 1] || ':' || s || ':' || e, ',' order by s, k, e) spans, string_agg(['assign', 'access', 'hex', 'random'][k + 1] || ':' || s || ':' || e, ',' order by s, k, e) filter (k < 3) own from every group by 1)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(own, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_random, 0) n_random from d left join o using (doc_id)"""


ORACLE_SQL = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op8_secret_scans": _secrets(),
}
