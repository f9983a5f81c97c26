"""SQL that some of the queries are held against: the same definitions written a second time, without automata, signatures and indexes.

Texts are folded by SQL's own functions; letters with a compatibility form are replaced by a rule over Unicode. Words that mix scripts keep
their letters here, so a result could differ where such a word decides; on the test data none does.
"""

from __future__ import annotations

import unicodedata as ud

from corvina.llm.lookalike import _ODD_SET


def _class(chars: set[str]) -> str:
    """The inside of a character class, by code."""
    runs: list[list[int]] = []
    for o in sorted(map(ord, chars)):
        if runs and o == runs[-1][1] + 1:
            runs[-1][1] = o
        else:
            runs.append([o, o])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in runs)


_PLAIN = [(c, p) for c in sorted(_ODD_SET) if len(p := ud.normalize("NFKC", c)) == 1 and p != c and p.isalnum()]
_FOLD = f"lower(strip_accents(translate(translate(coalesce({{0}}, ''), '{''.join(c for c, _ in _PLAIN)}', '{''.join(p for _, p in _PLAIN)}'), 'ıİ', 'ii')))"
_SPLIT = f"list_filter(string_split_regex({_FOLD}, '[^\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda x: x <> '')"

_PICTURES = "\\x{200d}\\x{fe0f}\\x{2600}-\\x{27bf}\\x{2b00}-\\x{2bff}\\x{1f000}-\\x{1faff}"
_LATIN, _OTHERS = "A-Za-z\\x{c0}-\\x{24f}", "\\p{Greek}\\p{Cyrillic}\\p{Armenian}\\p{Cherokee}\\p{Coptic}\\p{Georgian}\\p{Lisu}"
_ODD = "|".join([
    f"[{_class(_ODD_SET)}]", f"(^|[^{_PICTURES}])\\x{{200d}}", f"\\x{{200d}}([^{_PICTURES}]|$)", f"(^|[^{_PICTURES}\\x{{203c}}-\\x{{2bff}}0-9#*©®])\\x{{fe0f}}",
    f"[{_LATIN}][0-9]*[{_OTHERS}]", f"[{_OTHERS}][0-9]*[{_LATIN}]", "\\p{Cyrillic}[0-9]*[\\p{Greek}\\p{Armenian}]", "[\\p{Greek}\\p{Armenian}][0-9]*\\p{Cyrillic}",
])

_ALIKE = f"""s as (select id, arg_max(caption, updated_at) c from social_posts where id is not null group by 1), w as (select id, list_sort(list_distinct({_SPLIT.format('c')})) ws from s), v as (select id, ws, len(ws) n from w where len(ws) >= 10),
  e as (select a.id x, b.id y, a.ws wx, b.ws wy from v a join v b on a.id <> b.id and a.n >= 0.7 * b.n and b.n >= 0.7 * a.n where len(list_intersect(a.ws, b.ws)) >= 0.7 * (a.n + b.n - len(list_intersect(a.ws, b.ws)))),
  g(root, id) as (select x, x from e union select g.root, e.y from g join e on e.x = g.id)"""
_LEAKS = f"""w as (select item_id, {_SPLIT.format('text')} ws from eval_items), r as (select distinct item_id, array_to_string(ws[i:i + 9], '') run from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) i from w where len(ws) > 0)),
  t as (select doc_id, array_to_string({_SPLIT.format('text')}, '') letters from documents), f as (select distinct doc_id, item_id from t join r on contains(t.letters, r.run))"""

SQL = {
    "p2_found": f"""with x as (select 'social_posts' as table_name, id as record_id, arg_max(caption, updated_at) t from social_posts group by id union all select 'products', id, arg_max(product_name, updated_at) from products group by id)
      select table_name, record_id from x where regexp_matches(t, '{_ODD}') or t <> nfc_normalize(t)""",
    "p3_found": f"with recursive {_ALIKE} select root as post_id_a, id as post_id_b from g where root < id",
    "p3_groups": f"""with recursive {_ALIKE}, l as (select x as id, count(distinct case when wx <> wy then wy end) + count(*) filter (wx = wy) as links from e group by 1), m as (select root as id, min(id) as group_id from g group by 1)
      select v.id, coalesce(m.group_id, v.id) as group_id, coalesce(l.links, 0) as links from v left join m on m.id = v.id left join l on l.id = v.id""",
    "p8_found": f"with {_LEAKS} select doc_id, item_id from f",
    "p8_items": f"with {_LEAKS} select e.item_id, e.suite, e.lang, count(*) as documents from f join eval_items e on e.item_id = f.item_id group by 1, 2, 3",
}
