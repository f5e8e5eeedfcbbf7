"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from .plans.synth import BASE, EXPRESSIONS, METRICS
from .queries import AS_OF, SCENARIO, WIDE

_DERIVED = [m[0].removeprefix("metric_") for m in METRICS[4:]]

FACTS = """
lines as (
  select replace(lower(r_name), ' ', '_') as region, n_nationkey as nk, year(o_orderdate) as y, quarter(o_orderdate) as q,
         case when year(o_orderdate) < 2000 then 'actual' else 'estimate' end as actuality,
         case when year(o_orderdate) < 2000 then null when o_orderstatus = 'F' then 'scenario_base'
              when o_orderstatus = 'O' then 'scenario_bull' when o_orderstatus = 'P' then 'scenario_bear' end as scenario_id,
         l_orderkey, l_linestatus, l_extendedprice::DECIMAL(18,2) as price,
         l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(4,2) as off, l_quantity::DECIMAL(18,2) as qty
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
facts as (
  select region, nk, y, q, actuality, scenario_id, v, sum(price)::DOUBLE as gross_revenue, sum(off)::DOUBLE as discount_amount,
         count(distinct l_orderkey)::DOUBLE as order_count, sum(qty)::DOUBLE as quantity
  from lines, (values (1), (2)) t(v) where v = 2 or l_linestatus = 'F' group by all),
metric_list(rank, metric) as (values {metrics}),
all_obs as (
  select (((nk * 400 + (y - 1990) * 4 + q) * 2 + v) * 32 + rank * 4
          + coalesce(case scenario_id when 'scenario_base' then 1 when 'scenario_bull' then 2 when 'scenario_bear' then 3 end, 0))::BIGINT as ord,
         'model_' || region as model_id, 'metric_' || metric as metric_id, 'entity_nation_' || nk as entity_id,
         case when v = 1 then '2000-06-30' else '2001-12-31' end as as_of, 'version_1' as version_id,
         'obs_' || nk || '_' || metric || '_' || y || 'q' || q || '_' || coalesce(replace(scenario_id, 'scenario_', ''), 'actual') || '_' || v as id,
         'period_' || y || 'q' || q as period_id, scenario_id, actuality,
         case when rank >= 4 then 'null' else 'number' end as kind,
         case rank when 0 then gross_revenue when 1 then discount_amount when 2 then order_count when 3 then quantity end as num,
         case when rank >= 4 then 'derived' when actuality = 'actual' then 'reported' else 'assumption' end as value_type,
         case when rank >= 4 then 'transformation_' || metric end as transformation_id
  from facts, metric_list),
obs as (select * from all_obs where transformation_id is null),
periods as (
  select 'period_' || y || 'q' || q as id, y || ' Q' || q as label, 'fiscal_quarter' as type, make_date(y, q * 3 - 2, 1)::VARCHAR as key
  from range(1992, 2004) a(y), range(1, 5) b(q)),
metrics(id, name, data_type, ord, tags) as (values {metric_rows}),
relationships(id, from_id, type, to_id, ord) as (values {relationships}),
transformations(id, output_metric_id, status, expression, ord) as (values {transformations})
""".format(
    metrics=", ".join(f"({i}, '{m}')" for i, m in enumerate(BASE + _DERIVED)),
    metric_rows=", ".join(f"('{i}', '{n}', '{t}', {k}::BIGINT, '{' '.join(tags)}')" for k, (i, n, t, tags, _) in enumerate(METRICS)),
    relationships=", ".join(f"('relationship_{k}', '{i}', 'component_of', '{p}', {k}::BIGINT)" for k, (i, _, _, _, p) in enumerate(METRICS) if p),
    transformations=", ".join(f"('{i}', '{m}', 'supported', '{e.replace(chr(39), chr(39) * 2)}', {k}::BIGINT)" for k, (i, m, e) in enumerate(EXPRESSIONS)),
)


def _q(body: str, more: str = "", recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{FACTS}{', ' + more if more else ''} {body}"


def _series(as_of: str, scenario: str, where: str = "true") -> str:
    return f"""ranked as (select *, row_number() over (partition by model_id, metric_id, entity_id, period_id order by as_of desc, ord) as rn
      from obs where as_of <= '{as_of}' and (actuality = 'actual' or scenario_id = '{scenario}') and {where}),
    latest as (select * from ranked where rn = 1)"""


_TABLE = _series(AS_OF, SCENARIO) + """,
fin as (select model_id, entity_id, metric_id, m.name as metric_name, m.ord as metric_ord, period_id, p.label as period_label, p.key as period_key, actuality, num
        from latest join periods p on p.id = period_id join metrics m on m.id = metric_id)"""

_CONTEXT = "model_id, metric_id, entity_id, as_of, version_id"
_AXIS = """outs as (select id as out_id, model_id, entity_id, version_id, as_of as out_as_of, scenario_id as out_scenario, period_id as out_period, transformation_id
         from all_obs where transformation_id is not null),
axis as (select model_id, entity_id, version_id, out_as_of, out_scenario, type as period_type, period_id,
                row_number() over (partition by model_id, entity_id, version_id, out_as_of, out_scenario, type order by key, period_id) as pos
         from (select distinct o.model_id, o.entity_id, o.version_id, out_as_of, out_scenario, a.period_id
               from (select distinct model_id, entity_id, version_id, out_as_of, out_scenario from outs) o
               join all_obs a using (model_id, entity_id, version_id)
               where a.as_of <= out_as_of and (out_scenario is null or a.actuality = 'actual' or a.scenario_id = out_scenario)) s
         join periods p on p.id = s.period_id)"""
_INPUTS = _AXIS + """,
refs(transformation_id, ref, metric_id, off) as (values
  ('transformation_net_revenue', 'metric_gross_revenue|0', 'metric_gross_revenue', 0), ('transformation_net_revenue', 'metric_discount_amount|0', 'metric_discount_amount', 0),
  ('transformation_net_margin', 'metric_gross_revenue|0', 'metric_gross_revenue', 0), ('transformation_net_margin', 'metric_net_revenue|0', 'metric_net_revenue', 0),
  ('transformation_growth', 'metric_gross_revenue|0', 'metric_gross_revenue', 0), ('transformation_growth', 'metric_gross_revenue|-4', 'metric_gross_revenue', -4)),
wanted as (select o.*, ref, metric_id, case when off = 0 then out_period else t.period_id end as in_period
  from outs o join refs using (transformation_id)
  left join axis h on off <> 0 and h.model_id = o.model_id and h.entity_id = o.entity_id and h.version_id = o.version_id and h.out_as_of = o.out_as_of
       and h.out_scenario is not distinct from o.out_scenario and h.period_id = o.out_period
  left join axis t on off <> 0 and t.model_id = o.model_id and t.entity_id = o.entity_id and t.version_id = o.version_id and t.out_as_of = o.out_as_of
       and t.out_scenario is not distinct from o.out_scenario and t.pos = h.pos + off),
cand as (select w.out_id, w.transformation_id, w.ref, w.metric_id, w.in_period, a.id as in_id, a.num,
       row_number() over (partition by out_id, ref order by a.id is null, (a.scenario_id is not distinct from out_scenario) desc, a.as_of desc, a.ord) as rn
  from wanted w left join all_obs a on a.model_id = w.model_id and a.metric_id = w.metric_id and a.entity_id = w.entity_id and a.version_id = w.version_id
       and a.period_id = w.in_period and a.as_of <= out_as_of and (out_scenario is null or a.actuality = 'actual' or a.scenario_id = out_scenario)),
inputs as (select out_id, transformation_id, ref, metric_id, in_period, in_id, num from cand where rn = 1),
deps as (select distinct in_id as id, out_id as dependent_id from inputs where in_id is not null)"""


def _round(x: str, n: int) -> str:
    y = f"(({x}) * 1e{n})"
    return f"((floor({y}) + case when {y} - floor({y}) >= 0.5 then 1 else 0 end) / 1e{n})"


# The driver's graph of formulas is fixed, so evaluation has a closed form over the resolved inputs.
_EVAL = _INPUTS + f""",
g as (select out_id, max(num) filter (ref = 'metric_gross_revenue|0') as gross, max(num) filter (ref = 'metric_discount_amount|0') as discount,
             max(num) filter (ref = 'metric_gross_revenue|-4') as past, max(in_id) filter (ref = 'metric_net_revenue|0') as net_id,
             any_value(transformation_id) as t from inputs group by 1),
net as (select out_id, gross - discount as net from g where t = 'transformation_net_revenue'),
evaluated as (
  select out_id as id, net as num from net
  union all select g.out_id, case when gross = 0 then null else {_round('net / gross', 6)} end from g join net n on n.out_id = net_id where t = 'transformation_net_margin'
  union all select out_id, {_round('gross / past - 1', 6)} from g where t = 'transformation_growth')"""

_EDIT = f""", ed as (select id, num from all_obs where metric_id = 'metric_gross_revenue' and period_id = 'period_1998q2' and as_of = '2001-12-31'),
hit as (select g.*, net, case when exists (select 1 from inputs i join ed on ed.id = in_id where i.out_id = g.out_id and ref like '%|0') then 1000 else 0 end as a,
        case when exists (select 1 from inputs i join ed on ed.id = in_id where i.out_id = g.out_id and ref like '%|-4') then 1000 else 0 end as p
        from g left join net using (out_id) where exists (select 1 from inputs i join ed on ed.id = in_id where i.out_id = g.out_id)),
moved as (select out_id, net as before, gross + 1000 - discount as after from hit where t = 'transformation_net_revenue'
  union all select h.out_id, {_round('n.net / gross', 6)}, {_round('(n.net + 1000) / (gross + 1000)', 6)} from hit h join net n on n.out_id = h.net_id where t = 'transformation_net_margin' and {_round('n.net / gross', 6)} <> {_round('(n.net + 1000) / (gross + 1000)', 6)}
  union all select out_id, {_round('gross / past - 1', 6)}, {_round('(gross + a) / (past + p) - 1', 6)} from hit where t = 'transformation_growth' and past is not null and {_round('gross / past - 1', 6)} <> {_round('(gross + a) / (past + p) - 1', 6)})"""

_REVIEW = """
mo as (select 'model_' || replace(lower(r_name), ' ', '_') as id, r_name as name, 'entity_nation_' || min(n_nationkey) as primary_entity_id, r_regionkey as ord
       from region join nation on n_regionkey = r_regionkey group by all),
cells as (select *, ((ord % 32) // 4) as rk, (ord // 64) % 400 as qt from all_obs),
placed as (select *, (case when qt % 9 = 0 then '$' else '' end) || chr((65 + qt % 26)::INT) || (10 + rk) as cell from cells),
records as (select id as target_id, 'context_' || ord % 6 as context_id, model_id as sheet, cell, case when ord % 5 = 0 then 0.5 end as confidence,
            case when ord % 7 = 0 then 'corrected' end as review_status, ord from placed where ord % 11 <> 0
            union all select id, 'context_' || ord % 6, 'Metrics', 'A' || (20 - ord), null, null, ord - 100 from metrics where ord % 3 <> 1),
contexts as (select 'context_' || i as id, 'artifact_' || i % 2 as source_artifact_id, 'run_1' as extraction_run_id, 0.9 - (i % 3) * 0.1 as confidence,
             case when i % 3 = 0 then 'unreviewed' else 'confirmed' end as review_status, i as ord from range(6) t(i)),
prov as (select r.target_id, source_artifact_id, coalesce(r.confidence, c.confidence)::DOUBLE as confidence, coalesce(r.review_status, c.review_status) as review_status, cell
         from records r join contexts c on c.id = context_id),
items as (select 'item_' || id as id, case when ord % 4 = 0 then id when ord % 4 = 1 then metric_id when ord % 4 = 2 then transformation_id when ord % 8 = 3 then model_id end as target_id,
          case when ord % 5 = 0 then model_id end as model_id, case when ord % 3 = 0 then model_id end as sheet, case when ord % 3 = 0 then cell end as cell,
          case when ord % 8 = 0 then 'source_error' else 'formula' end as category,
          case when ord % 6 < 2 then 'action_required' else 'needs_review' end as attention_level,
          case ord % 12 when 0 then 'model_owner' when 1 then 'source_owner' end as action_owner,
          case when ord % 17 = 0 then 'resolved' else 'open' end as status, ord from placed where ord % 13 = 0),
presentations as (select 'presentation_' || m.id || '_' || n as id, m.id as model_id, case when n = 2 then m.id end as sheet, m.ord * 2 + n as ord, n, 'Table' as title
                  from mo m, range(1, 3) t(n) where m.ord < 4),
shown as (select p.id as presentation_id, p.id || '_section_' || m.ord % 2 as section_id, m.id as metric_id, r.to_id as parent_id, m.ord
          from presentations p join metrics m on m.ord % 3 <> p.n % 3 left join relationships r on r.from_id = m.id),
ranks as (select m.id as metric_id, m.name, row_number() over (order by coalesce(r.sheet, ''), try_cast(r.cell[2:] as int) nulls last, m.name) as rank
          from metrics m left join records r on r.target_id = m.id)"""

_TREE = _REVIEW + """,
seen as (select distinct model_id, metric_id from all_obs),
tree as (select model_id, metric_id, null::VARCHAR as parent_id, 0 as depth, [rank] as path from seen join ranks using (metric_id) where metric_id not in (select from_id from relationships)
         union all select s.model_id, s.metric_id, r.to_id, depth + 1, list_append(path, k.rank) from seen s join ranks k using (metric_id) join relationships r on r.from_id = s.metric_id
         join tree t on t.model_id = s.model_id and t.metric_id = r.to_id)"""

_SECTIONS = _TREE + """,
tser as (select * from (select a.*, row_number() over (partition by a.model_id, metric_id, entity_id, period_id order by as_of desc, a.ord) as rn
         from all_obs a join mo on mo.id = a.model_id and mo.primary_entity_id = a.entity_id where actuality = 'actual' or scenario_id = 'scenario_base') where rn = 1),
tcells as (select model_id, entity_id, metric_id, string_agg(period_id || '=' || id, ',' order by period_id) as cells, bool_or(value_type = 'derived') as derived from tser group by all),
pres as (select * from presentations qualify row_number() over (partition by model_id order by ord) = 1),
inside as (select s.*, p.model_id from shown s join pres p on p.id = s.presentation_id),
deep as (select presentation_id, section_id, metric_id, 0 as depth from inside i where not exists (select 1 from inside j where j.section_id = i.section_id and j.metric_id = i.parent_id and j.ord < i.ord)
         union all select i.presentation_id, i.section_id, i.metric_id, d.depth + 1 from inside i join inside j on j.section_id = i.section_id and j.metric_id = i.parent_id and j.ord < i.ord join deep d on d.section_id = j.section_id and d.metric_id = j.metric_id),
trows as (select model_id, presentation_id, section_id, 'Section ' || right(section_id, 1) as section_title, ord as pos, metric_id, depth from inside join deep using (presentation_id, section_id, metric_id)
          union all select model_id, null, 'section_' || replace(model_id, 'model_', '') || '_metrics', 'Model metrics', row_number() over (partition by model_id order by path), metric_id, depth
          from tree where model_id not in (select model_id from presentations)),
mine as (select t.model_id, t.metric_id, count(*) as n_open, bool_or(attention_level = 'action_required') as act
         from (select distinct model_id, metric_id from trows) t join items i on i.target_id = t.metric_id and i.status = 'open' and (i.model_id is null or i.model_id = t.model_id) group by all),
ttable as (select t.model_id, c.entity_id, presentation_id, section_id, section_title, pos, metric_id, m.name as metric_name, tags, depth, r.sheet, r.cell, coalesce(n_open, 0) as n_open,
             case when act then 'action_required' when n_open > 0 then 'needs_review' end as attention, derived, cells,
             case when presentation_id is null then first_value(r.cell ignore nulls) over (partition by t.model_id, section_id order by pos rows between unbounded preceding and unbounded following) end as section_cell
           from trows t join tcells c using (model_id, metric_id) join metrics m on m.id = metric_id left join records r on r.target_id = metric_id left join mine using (model_id, metric_id))"""

_QUEUE = _REVIEW + """,
place as (select model_id, sheet, replace(upper(cell), '$', '') as c, regexp_extract(replace(upper(cell), '$', ''), '^([A-Z]+)[0-9]', 1) as col, period_id
          from records join (select id as target_id, model_id, period_id from all_obs) using (target_id)),
x as (select model_id, sheet, c, min(period_id) as period_id from place group by all having count(distinct period_id) = 1),
yy as (select model_id, sheet, col, min(period_id) as period_id from place group by all having count(distinct period_id) = 1),
fm as (select metric_id, arg_min(model_id, ord) as model_id from all_obs group by 1),
j as (select i.id, attention_level, action_owner, coalesce(o.metric_id, m.id, t.output_metric_id) as metric_id, coalesce(i.model_id, o.model_id, t_mo.id) as known_model, t_mo.name as target_name,
             case when i.sheet is not null then i.cell else r.cell end as cell, coalesce(i.sheet, r.sheet) as sheet, o.period_id as o_period
      from items i left join all_obs o on o.id = i.target_id left join metrics m on m.id = i.target_id left join mo t_mo on t_mo.id = i.target_id
      left join transformations t on t.id = i.target_id left join records r on r.target_id = i.target_id where i.status = 'open'),
k as (select j.*, coalesce(known_model, fm.model_id) as model_id from j left join fm using (metric_id)),
queue as (select k.id, attention_level, action_owner, k.model_id, metric_id, k.sheet, k.cell, mo.name as model_name,
             try_cast(nullif(regexp_extract(replace(k.cell, '$', ''), '^[A-Za-z]+([0-9]+)', 1), '') as BIGINT) as row,
             coalesce(o_period, x.period_id, yy.period_id) as period_id,
             coalesce(m.name || ' · ' || p.label, m.name, target_name, mo.name || ' model', 'Workbook-level issue') as label
      from k left join x on x.model_id = k.model_id and x.sheet = k.sheet and x.c = replace(upper(k.cell), '$', '')
      left join yy on yy.model_id = k.model_id and yy.sheet = k.sheet and yy.col = regexp_extract(replace(upper(k.cell), '$', ''), '^([A-Z]+)[0-9]', 1)
      left join metrics m on m.id = metric_id left join periods p on p.id = o_period left join mo on mo.id = k.model_id)"""

_BROKEN = _REVIEW + """,
b0 as (select * replace (
    case when ord % 97 = 0 then 'version_9' else version_id end as version_id, case when ord % 103 = 0 then 'metric_unknown' else metric_id end as metric_id,
    case when ord % 107 = 0 then 'period_unknown' else period_id end as period_id, case when ord % 109 = 0 then 'entity_unknown' else entity_id end as entity_id,
    case when ord % 89 = 0 then 'string' else kind end as kind, case when ord % 89 = 0 then null when ord % 113 = 0 then num + 0.5 else num end as num,
    case when ord % 83 = 0 then 'derived' else value_type end as value_type,
    case when ord % 127 = 0 and transformation_id is not null then 'transformation_growth' else transformation_id end as transformation_id) from all_obs),
b as (select * from b0 union all select * replace (ord + 1000000000 as ord, case when ord % 2 = 0 then id || '_again' else id end as id) from b0 where ord % 101 = 0),
bt as (select * from transformations union all values ('transformation_spare', 'metric_gone', 'supported', 'ref(''a'') + b', 10),
       ('transformation_twin', 'metric_net_revenue', 'supported', 'ref(''metric_gross_revenue'') - ref(''metric_discount_amount'')', 11)),
br as (select * from relationships union all values ('relationship_x', 'metric_quantity', 'component_of', 'metric_gross_revenue', 20), ('relationship_y', 'metric_gone', 'component_of', 'metric_quantity', 21)),
bs as (select transformation_id, period_id, case when bool_or(ord % 5 = 0) then 'B1' else ' =Z1' end as formula from b0
       where transformation_id is not null and ord % 3 <> 0 and period_id <> 'period_1995q3' group by 1, 2
       union all select 'transformation_spare', 'period_gone', '=A1'),
bc as (select * from contexts union all select * replace (id || '_b' as id, ord + 10 as ord, case when ord = 1 then 'run_9' else extraction_run_id end as extraction_run_id) from contexts where ord < 2),
bp as (select * from records union all select * replace (ord + 1000000000 as ord) from records where ord % 37 = 0),
bme as (select id, ord from metrics union all select 'metric_idle', 7),
bm as (select presentation_id, case when presentation_id = 'presentation_model_america_1' then replace(section_id, 'america_1', 'africa_2') else section_id end as section_id, metric_id,
              case when metric_id = 'metric_gross_revenue' and presentation_id like '%2' then 'metric_net_revenue' when metric_id = 'metric_order_count' then 'metric_gone' else parent_id end as parent_id, ord
       from (select * from shown union all select * replace (ord + 100 as ord) from shown where ord = 1)
       union all select 'presentation_model_africa_1', 'presentation_model_africa_1_section_0', 'metric_idle', null, 500),
bpr as (select * replace (case when ord = 6 then 'unnamed_presentation_6' else id end as id, case when ord <> 4 then title end as title)
        from (select * from presentations union all select * replace (50 as ord) from presentations where ord = 1)),
ba(id, content_hash) as (values ('artifact_0', 'sha256:ab12'), ('artifact_1', 'sha256-xyz'), ('artifact_2', null)),
en as (select 'entity_nation_' || n_nationkey as id from nation),
sc(id) as (values ('scenario_base'), ('scenario_bull'), ('scenario_bear')),
bch as (select 'change_' || i as id, i as ord, i % 7 = 0 as odd, case when i % 3 = 0 then 'metric_gone' else 'metric_growth' end as metric_id from range(40) t(i)),
canon as (select id from mo union all select id from en union all select id from bme union all select id from periods union all select id from sc union all select id from b union all select id from bt
          union all select id from br union all select id from ba union all select id from bc union all select id from bch union all select 'run_1' union all select id from items)"""

_CYCLIC = _BROKEN + """,
ct as (select * replace (case when id = 'transformation_net_margin' then 'opaque' else status end as status) from bt union all values
       ('transformation_discount', 'metric_discount_amount', 'supported', 'x', 20), ('transformation_dark', 'metric_quantity', 'opaque', '', 21)),
co as (select * replace (case when metric_id = 'metric_discount_amount' then 'transformation_discount' else transformation_id end as transformation_id) from b),
said as (select distinct target_id from items where status = 'open' and category = 'formula' and attention_level = 'action_required' and target_id is not null),
cell as (select distinct model_id, period_id, transformation_id from co),
ring as (select a.model_id, a.period_id from cell a join cell c using (model_id, period_id) where a.transformation_id = 'transformation_net_revenue' and c.transformation_id = 'transformation_discount')"""


def _rule(code: str, field: str, select: str) -> str:
    return _q(f"select '{code}' as code, object_id, '{field}' as field from ({select})", _BROKEN)


def _miss(table: str, column: str, ids: str, field: str, key: str = "id") -> str:
    return f"select 'reference.missing' as code, {key} as object_id, {field if '||' in field else repr(field)} as field from {table} where {column} is not null and {column} not in (select id from {ids})"


_SITES = [
    ("mo", "primary_entity_id", "en", "primaryEntityId"), ("b", "model_id", "mo", "modelId"), ("b", "metric_id", "bme", "metricId"), ("b", "entity_id", "en", "entityId"), ("b", "period_id", "periods", "periodId"),
    ("b", "scenario_id", "sc", "scenarioId"), ("b", "transformation_id", "bt", "transformationId"), ("bt", "output_metric_id", "bme", "outputMetricId"), ("bs", "period_id", "periods", "'sourceExpressions.' || period_id", "transformation_id"),
    ("bpr", "model_id", "mo", "modelId", "model_id"), ("bm", "metric_id", "bme", "metricIds", "section_id"), ("br", "from_id", "canon", "fromId"), ("br", "to_id", "canon", "toId"),
    ("(select 'run_1' as id, 'artifact_9' as a)", "a", "ba", "sourceArtifactIds.1"), ("bc", "source_artifact_id", "ba", "sourceArtifactId"), ("bc", "extraction_run_id", "(select 'run_1' as id)", "extractionRunId"),
    ("bp", "target_id", "canon", "targetId", "target_id"), ("bp", "context_id", "bc", "contextId", "target_id"), ("bch", "metric_id", "bme", "metricId"),
    ("items", "model_id", "mo", "modelId"), ("items", "target_id", "canon", "targetId"), ("(select 'transformation_spare' as id, 'a' as m)", "m", "bme", "expression.dependencies.0"),
]


def _cyclic(code: str, field: str, select: str) -> str:
    return _q(f"select {code} as code, object_id, '{field}' as field from ({select})", _CYCLIC)


RULES = {
    "references": _q(" union all ".join(_miss(*x) for x in _SITES), _BROKEN),
    "contract": _q("select 'schema.invalid' as code, object_id, field from (select id as object_id, 'currentTreatment' as field from items where ord % 7 = 0 union all select id, 'nextAction' from items where ord % 3 = 0 union all select id, 'actionOwner' from items where attention_level = 'action_required' and action_owner is null)", _BROKEN),
    "observation_version": _rule("observation.version", "versionId", "select id as object_id from b where version_id <> 'version_1'"),
    "observation_value_type": _rule("observation.value_type", "value", "select b.id as object_id from b join metrics m on m.id = metric_id where kind <> 'null' and (kind <> 'number' or (data_type = 'count' and num <> floor(num)))"),
    "observation_transformation": _rule("observation.transformation", "transformationId", "select id as object_id from b where value_type = 'derived' and transformation_id is null"),
    "series_duplicate": _rule("observation_series.duplicate", "observationSeries", f"select concat_ws('/', {_CONTEXT}) as object_id from (select {_CONTEXT}, min(ord) as s from b0 group by all) where s % 5 = 0"),
    "duplicate_point": _rule("observation.duplicate_point", "points", f"select id as object_id from b qualify row_number() over (partition by {_CONTEXT}, period_id, coalesce(scenario_id, 'none') order by ord) > 1"),
    "id_duplicate": _rule("id.duplicate", "id", "select id as object_id from b qualify row_number() over (partition by id order by ord) > 1"),
    "transformation_unused": _rule("transformation.unused", "id", "select id as object_id from bt where id not in (select transformation_id from b where transformation_id is not null)"),
    "transformation_output_metric": _rule("transformation.output_metric", "transformationId", "select b.id as object_id from b join bt on bt.id = transformation_id where metric_id <> output_metric_id"),
    "transformation_source_expression": _rule("transformation.source_expression", "sourceExpressions", "select transformation_id as object_id from bs where ltrim(formula) not like '=%'"),
    "transformation_source_period": _rule("transformation.source_period", "periodId", "select id as object_id from b where transformation_id is not null and not exists (select 1 from bs where bs.transformation_id = b.transformation_id and bs.period_id = b.period_id)"),
    "transformation_source_without_output": _rule("transformation.source_without_output", "sourceExpressions", "select transformation_id || '/' || period_id as object_id from bs where not exists (select 1 from b where bs.transformation_id = b.transformation_id and bs.period_id = b.period_id)"),
    "provenance_missing": _rule("provenance.missing", "provenanceRecords", "select id as object_id from canon where id not in (select target_id from bp) and id not in (select id from ba union all select id from bc union all select 'run_1') group by 1"),
    "provenance_duplicate": _rule("provenance.duplicate", "provenanceRecords", "select target_id as object_id from bp qualify row_number() over (partition by target_id, context_id, sheet, cell order by ord) > 1"),
    "presentation_metric_missing": _rule("presentation.metric_missing", "sections", "select model_id || '/' || metric_id as object_id from (select distinct model_id, metric_id from b where model_id in (select model_id from bpr)) s where not exists (select 1 from bm join bpr p on p.id = presentation_id where p.model_id = s.model_id and bm.metric_id = s.metric_id)"),
    "presentation_duplicate_metric": _rule("presentation.duplicate_metric", "metricIds", "select presentation_id || '/' || metric_id as object_id from bm qualify row_number() over (partition by presentation_id, metric_id order by ord) > 1"),
    "presentation_metric_not_visible": _rule("presentation.metric_not_visible", "metricIds", "select presentation_id || '/' || metric_id as object_id from bm join bpr p on p.id = presentation_id where not exists (select 1 from b where b.model_id = p.model_id and b.metric_id = bm.metric_id)"),
    "presentation_parents": _q("select case when p.metric_id is null then 'presentation.parent_unknown' else 'presentation.parent_order' end as code, concat_ws('/', c.presentation_id, c.section_id, c.metric_id) as object_id, 'metricParentIds' as field from (select distinct presentation_id, section_id, metric_id, parent_id from bm where parent_id is not null) c left join (select presentation_id, section_id, metric_id, max(ord) as ord from bm group by all) me on me.presentation_id = c.presentation_id and me.section_id = c.section_id and me.metric_id = c.metric_id left join (select presentation_id, section_id, metric_id, max(ord) as ord from bm group by all) p on p.presentation_id = c.presentation_id and p.section_id = c.section_id and p.metric_id = c.parent_id where p.metric_id is null or p.ord >= me.ord", _BROKEN),
}

_CATALOG = """
with recursive metrics as (select 'metric_' || p_partkey as id, p_partkey as ord from part where p_partkey % 37 <> 0),
plain as (
  select p_partkey as k, 'transformation_' || p_partkey as id, case when p_partkey % 19 = 0 then 'metric_gone_' else 'metric_' end || p_partkey as output_metric_id,
         case when p_size % 9 = 0 then 'opaque' else 'supported' end as status from part),
formulas as (select k, id, output_metric_id, status, k as ord from plain union all select k, id || '_twin', output_metric_id, status, k + 1000000000 from plain where k % 23 = 0),
relations as (
  select 'relationship_' || p_partkey as id, 'metric_' || p_partkey as from_id, case when p_partkey % 13 = 0 then 'derived_from' else 'component_of' end as type, 'metric_' || (p_partkey * p_partkey + 1) % 101 as to_id, p_partkey as ord from part
  union all select 'relationship_' || p_partkey || '_b', case when p_partkey % 40 = 0 then 'metric_gone_' else 'metric_' end || p_partkey, 'component_of', 'metric_' || (p_partkey + 5), p_partkey + 1000000000 from part where p_partkey % 6 = 0),
components as (select * from relations where type = 'component_of'),
views as (
  select case when o_orderkey % 29 = 0 then 'unnamed_presentation_' || o_orderkey when o_orderkey % 50 = 0 then 'presentation_' || o_orderkey % 1000 else 'presentation_' || o_orderkey end as id,
         'model_' || o_custkey as model_id, case when o_orderkey % 31 <> 0 then o_orderpriority end as title, o_orderkey as ord from orders where o_custkey % 3 <> 0),
items as (
  select event_id as ord, 'item_' || event_id as id, list_extract(['formula', 'presentation', 'source_error'], event_id % 3 + 1) as category, event_id % 4 <> 3 as open, case when event_id % 5 < 2 then 'action_required' else 'needs_review' end as attention_level,
         case when event_id % 7 <> 6 then 'model_' || user_id end as model_id, case when event_id % 8 = 0 then 'transformation_' || user_id when event_id % 8 = 1 then 'metric_' || user_id when event_id % 8 > 2 then 'model_' || user_id end as target_id,
         case when event_id % 8 = 2 then ['transformation_' || user_id + 1, 'metric_' || user_id] else [] end as affected from events),
bare as (
  select 'model_' || c_custkey as id, (select min(i.ord) from items i where i.open and i.category = 'presentation' and i.model_id = 'model_' || c_custkey) as item
  from customer where 'model_' || c_custkey not in (select model_id from views)),
acts as (select ord, unnest(list_append(affected, target_id)) as t from items where open and category = 'formula' and attention_level = 'action_required'),
opaque as (select f.id, min(a.ord) as item from formulas f left join acts a on a.t = f.id or a.t = f.output_metric_id where status = 'opaque' group by 1)
"""


def _catalog(code: str, field: str, select: str) -> str:
    code = code if code.startswith("case") or code == "code" else f"'{code}'"
    return f"{_CATALOG} select {code} as code, object_id, '{field}' as field from ({select})"


_CYCLE_OF_THREE = """select 'metric_' || a.k as object_id, a.k from plain a join plain b on b.k = a.k + 1 join plain c on c.k = a.k + 2
  where a.k % 10 = 0 and 'opaque' not in (a.status, b.status, c.status) and a.k % 19 <> 0 and b.k % 19 <> 0 and c.k % 19 <> 0"""
RULES |= {
    "transformation_expression": _catalog("transformation.expression", "expression", "select id as object_id from formulas where status = 'supported' and k % 10 in (4, 6, 7, 8)"),
    "transformation_duplicate": _catalog("transformation.duplicate", "expression", "select id as object_id from formulas where id like '%twin'"),
    "transformation_cycle": _catalog("transformation.cycle", "expression", _CYCLE_OF_THREE),
    "transformation_opaque": _catalog("code", "status", "select id as object_id, case when item is null then 'transformation.opaque_action_required' else 'transformation.opaque' end as code from opaque"),
    "component_metric": _catalog("relationship.component_metric", "type", "select id as object_id from components where from_id not in (select id from metrics) or to_id not in (select id from metrics)"),
    "component_multiple_parents": _catalog("relationship.component_multiple_parents", "fromId", "select id as object_id from (select *, first(to_id) over (partition by from_id order by ord) as f from components where from_id in (select id from metrics) and to_id in (select id from metrics)) where to_id <> f"),
    "component_cycle": _CATALOG + """, up as (select from_id as id, min_by(to_id, ord) as p from components group by 1),
      walk as (select id as start, p as here, 1 as n from up union all select start, up.p, n + 1 from walk join up on up.id = here where here <> start and n <= 150),
      ring as (select distinct start from walk where here = start),
      least as (select start, least(start, min(here)) as low from walk where start in (select start from ring) group by 1)
      select distinct 'relationship.component_cycle' as code, low as object_id, 'relationships' as field from least""",
    "artifact_content_hash": _catalog("artifact.content_hash", "contentHash", "select 'artifact_' || s_suppkey as object_id from supplier where s_suppkey % 5 in (1, 3)"),
    "provenance_context_duplicate": _catalog("provenance_context.duplicate", "provenanceContexts", "select 'context_' || s_suppkey as object_id from supplier qualify row_number() over (partition by s_suppkey % 7, s_suppkey % 9 order by s_suppkey) > 1"),
    "decision_change_value_type": _catalog("decision_change.value_type", "before/after", "select 'change_' || event_id as object_id from events where event_type = 'error'"),
    "model_current_version": _catalog("model.current_version", "currentVersionId", "select 'model_' || c_custkey as object_id from customer where c_custkey % 3 = 2"),
    "presentation_duplicate_id": _catalog("presentation.duplicate_id", "id", "select id as object_id from views qualify row_number() over (partition by id order by ord) > 1"),
    "presentation_duplicate_section": _catalog("presentation.duplicate_section", "id", "select 'section_' || n as object_id from (select unnest(case when o_orderkey % 41 = 0 then [o_orderkey, o_orderkey] when o_orderkey % 43 = 0 then [o_orderkey - 1] else [o_orderkey] end) as n, o_orderkey as ord from orders where o_custkey % 3 <> 0) qualify row_number() over (partition by n order by ord) > 1"),
    "presentation_names": _CATALOG + ", several as (select * from views qualify count(*) over (partition by model_id) > 1) select 'presentation.id_required' as code, id as object_id, 'id' as field from several where id like 'unnamed%' union all select 'presentation.title_required', id, 'title' from several where title is null",
    "presentation_missing": _catalog("code", "tablePresentations", "select id as object_id, case when item is null then 'presentation.missing' else 'presentation.fallback' end as code from bare"),
    "extraction_run_open_attention": _catalog("extraction_run.open_attention", "status", "select distinct 'run_' || s.s_suppkey % 9 as object_id from events join supplier s on s.s_suppkey = event_id % 50 join supplier r on r.s_suppkey = s.s_suppkey % 9 where event_id % 97 = 0 and event_id % 4 <> 3 and r.s_suppkey % 2 = 0"),
    "open_items": _catalog("code", "status", "select id as object_id, 'unresolved.' || attention_level as code from items where open and ord not in (select item from bare where item is not null union all select item from opaque where item is not null)"),
    "unresolved_repair_required": _catalog("unresolved.repair_required", "attentionLevel", "select id as object_id from items where open and category = 'source_error' and attention_level <> 'action_required'"),
}

_FORMULA = "list_extract(['=1+2', '= 50%*2', '=A1*2', '=SUM(3,4)', '', '=1.5e3/2', '=(2-1)^2'], l_linenumber)"


def _sums(total: str) -> str:
    return f"""select a.l_orderkey, round(({total})::DOUBLE, 4) as total from (select c.l_orderkey, v.l_extendedprice::DECIMAL(18,2) as v,
      (c.l_orderkey % 2 = 0 and c.l_linenumber % 2 = 0 and c.l_returnflag = 'R') or (c.l_orderkey % 2 = 1 and c.l_linenumber % 2 = 1 and c.l_quantity = 17) as same
      from lineitem c join lineitem v on v.l_orderkey = c.l_orderkey and v.l_linenumber = c.l_linenumber + 1) a group by 1"""


def _format(inspector: bool) -> str:
    """Display texts by exact decimals of the values' shortest forms."""
    most = 2 if inspector else 1
    sign = "'-' || u" if inspector else "'(' || u || ')'"
    return rf"""with v as (select l_orderkey, l_linenumber, l_returnflag as f, l_quantity as q,
        list_extract(['percentage', 'count', 'currency', 'number', 'percentage', 'text', 'boolean'], l_linenumber) as k,
        case when l_linenumber in (1, 5) then l_quantity / 32 - 0.75 else l_quantity * 250 - 6000 + l_linenumber * 2 / 16 + l_quantity / 64 end as x from lineitem),
      s as (select *, abs(x)::VARCHAR::DECIMAL(38,12) * case when k = 'percentage' then 100 else 1 end as s from v),
      t as (select *, case when k = 'count' then round(s, 0)::DECIMAL(38,0)::VARCHAR else round(s, {most})::DECIMAL(38,{most})::VARCHAR end as t from s),
      u as (select *, regexp_replace(split_part(t, '.', 1), '(\d)(\d{{3}})$', '\1,\2') || case when contains(t, '.') then '.' || split_part({"regexp_replace(t, '0$', '')" if inspector else "t"}, '.', 2) else '' end as u from t)
      select l_orderkey, l_linenumber, case when q = 13 then '—' when k = 'text' then f when k = 'boolean' then case when q > 25 then 'Yes' else 'No' end
        when k = 'percentage' then case when x < 0 then '-' else '' end || u || '%' when x < 0 then {sign} else u end as text from u"""

def _deep(step: str, start: str = "l_quantity") -> str:
    """``step`` over itself eight times, a select for each, so that the text grows in proportion."""
    source = f"select l_orderkey, l_linenumber, l_tax, {start} as v from lineitem"
    for _ in range(8):
        source = f"select l_orderkey, l_linenumber, l_tax, {step} as v from ({source})"
    return source


_NESTED = "select l_orderkey, l_linenumber, case when not isnan(v) then round(v, 6) end as num, case when isnan(v) then '- requires a finite number' end as error from (" + " union all ".join(
    f"select * from ({_deep(step)}) where l_linenumber = {n}"
    for n, step in enumerate(["floor(v * 3 / 2 * 10 + 0.5) / 10", "v - 11 * floor(v / 11) + l_tax", "case when v > 30 then v - 20 else v + 7 end", "greatest(v / 2, least(v, 9))", "case when isinf(v) or isnan(v) then 'nan'::DOUBLE else 100 / (v - 5) end", "case when v = 3 then 4 else v end"], 1)
) + " union all select l_orderkey, l_linenumber, l_tax, null from lineitem where l_linenumber > 6)"


_SHEET_ROWS = "(select *, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag) as n from lineitem)"


_EXTRACTED = f"""
with r as (select 'book' || l_orderkey % 100 as path, 'S' || l_orderkey as sheet, n, l_quantity as q, l_tax as t from {_SHEET_ROWS}),
x as (
  select *, lower(c) || '_' || sheet as m, case c when 'D' then 'ref(''metric_b_' || sheet || ''') * 2' when 'E' then '(ref(''metric_c_' || sheet || ''') == 0 ? 7 : ref(''metric_b_' || sheet || ''') / ref(''metric_c_' || sheet || '''))' end as e
  from r, (values ('A'), ('B'), ('C'), ('D'), ('E'), ('F')) v(c) where c <> 'F' or n % 5 = 0),
y as (
  select *, case when e is not null then 'transformation_' || m || '_' || left(sha256('metric_' || m || chr(0) || 'supported' || chr(0) || e), 8) end as transformation_id,
         case when c = 'F' or (c = 'A' and n % 3 = 0) then 'missing_source_value' when c = 'D' and n % 2 = 0 then 'missing_value' when c = 'A' then 'incompatible_value' end as state from x)
"""


def oracle_sql() -> dict[str, str]:
    wide = ", ".join(f"max(num) filter (period_id = '{p}') as {p}" for p in WIDE)
    quarter = "(l_quantity - 25)"
    return {
        "observations_flatten": _q(f"select ord, {_CONTEXT}, id, period_id, scenario_id, num from obs"),
        "series_regroup": _q(f"select {_CONTEXT}, min(ord) as series_ord, count(*)::INT as n_points, string_agg(id, ',' order by ord) as point_ids from obs group by {_CONTEXT}"),
        "metric_series_asof": _q("select model_id, metric_id, entity_id, period_id, as_of, id, num from latest", _series(AS_OF, SCENARIO)),
        "metric_series_early": _q("select model_id, metric_id, entity_id, period_id, as_of, id, num from latest", _series("2000-12-31", "scenario_bear", "metric_id = 'metric_gross_revenue'")),
        "financial_table_long": _q("select model_id, entity_id, metric_id, metric_name, period_id, period_label, actuality, num from fin", _TABLE),
        "financial_table_wide": _q(f"select model_id, entity_id, metric_id, {wide} from fin group by 1, 2, 3", _TABLE),
        "period_types": _q("select model_id, type, min(key) as first_key from obs join periods p on p.id = period_id group by 1, 2"),
        "model_overview": _q(
            """select id as model_id, primary_entity_id, count(distinct o.metric_id) as n_metrics, count(*) as n_observations, count(*) filter (actuality = 'actual') as n_actual, count(*) filter (actuality = 'estimate') as n_estimate,
                 count(distinct entity_id) as n_entities, 3::BIGINT as n_transformations, any_value(n_open) as n_open, any_value(n_needs) as n_needs_review, any_value(n_open - n_needs) as n_action_required, any_value(n_un) as n_unreviewed
               from (select mo.id, primary_entity_id, coalesce(n_open, 0)::BIGINT as n_open, coalesce(n_needs, 0)::BIGINT as n_needs, coalesce(n_un, 0)::BIGINT as n_un from mo
                     left join (select model_id, count(*) as n_open, count(*) filter (attention_level = 'needs_review') as n_needs from items where status = 'open' group by 1) i on i.model_id = mo.id
                     left join (select model_id, count(*) as n_un from prov join (select model_id, id as target_id from all_obs union select model_id, metric_id from all_obs) using (target_id) where review_status = 'unreviewed' group by 1) u on u.model_id = mo.id) x
               join (select id as oid, * exclude (id) from all_obs) o on o.model_id = x.id group by id, primary_entity_id""",
            _REVIEW,
        ),
        "database_stats": _q("select (select count(*) from mo) as n_models, (select count(*) from metrics) as n_metrics, (select count(*) from all_obs) as n_observations, (select count(*) from transformations) as n_transformations, (select count(*) from items where status = 'open') as n_open, (select count(*) from items where status = 'open' and attention_level = 'needs_review') as n_needs_review, (select count(*) from items where status = 'open' and attention_level = 'action_required') as n_action_required, (select count(*) from prov where review_status = 'unreviewed') as n_unreviewed", _REVIEW),
        "sectioned_table": _q("select * exclude (tags) from ttable", _SECTIONS, True),
        "table_search": _q("select model_id, section_id, metric_id, depth from ttable where contains(lower(metric_name || ' ' || metric_id || ' ' || tags), 'sales')", _SECTIONS, True),
        "table_periods": _q("select model_id, period_id, row_number() over (partition by model_id order by key, period_id)::INT as n from (select distinct model_id, period_id from tser) join periods p on p.id = period_id", _SECTIONS, True),
        "initial_view": "select 'model_asia' as model_id, 'presentation_model_asia_1' as presentation_id, 'entity_nation_' || min(n_nationkey) as entity_id, 'fiscal_quarter' as period_type from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'",
        "lineage_highlight": _q("select out_id, count(*) filter (in_id in (select id from tser)) as n_shown, count(*) as n_total from (select distinct out_id, in_id from inputs where in_id is not null) group by 1", _SECTIONS + ", " + _INPUTS, True),
        "metrics_by_source": _q("select metric_id as id, name, rank::INT as rank from ranks", _REVIEW),
        "observation_detail": _q(
            """select o.id, mo.name as model_name, n_name as entity_name, m.name as metric_name, p.label as period_label, case when r.target_id is null then 0 else 1 end::INT as n_provenance,
                 coalesce(i.t, '') as inputs, coalesce(d.t, '') as dependents, coalesce(u.t, '') as open_items
               from all_obs o join mo on mo.id = o.model_id join nation on o.entity_id = 'entity_nation_' || n_nationkey join metrics m on m.id = o.metric_id join periods p on p.id = o.period_id left join records r on r.target_id = o.id
               left join (select out_id, string_agg(concat_ws('=', ref, in_id, n), ',' order by ref) as t from (select out_id, ref, in_id, case when r.target_id is null then 0 else 1 end as n from inputs left join records r on r.target_id = in_id) group by 1) i on i.out_id = o.id
               left join (select dd.id, string_agg(dependent_id, ',' order by replace(a.metric_id, '_', ' '), p.key, replace(dependent_id, '_', ' ')) as t from deps dd join all_obs a on a.id = dependent_id join periods p on p.id = a.period_id group by 1) d on d.id = o.id
               left join (select a.id, string_agg(i.id, ',' order by i.id) as t from all_obs a join items i on i.status = 'open' and i.target_id in (a.id, a.metric_id) and (i.model_id is null or i.model_id = a.model_id) group by 1) u on u.id = o.id""",
            _REVIEW + ", " + _INPUTS,
        ),
        "provenance_sources": _q("select target_id, source_artifact_id, 'Workbook ' || right(source_artifact_id, 1) as artifact, 'completed' as run_status, review_status, cell from prov", _REVIEW),
        "attention_by_target": _q("select target_id, id, model_id, attention_level from items where status = 'open' and target_id is not null", _REVIEW),
        "editable_cells": _q("select id, transformation_id is null as editable from all_obs"),
        "presentations_of_model": "select 'presentation_model_asia_' || n as id, (r_regionkey * 2 + n)::BIGINT as ord from region, range(1, 3) t(n) where r_name = 'ASIA'",
        "object_lookup": _q("select id, 'metrics' as collection, name as label from metrics where id = 'metric_growth' union all select 'model_asia', 'models', 'ASIA' union all select id, 'metric', name from metrics where id = 'metric_quantity' union all select 'model_europe', 'model', 'EUROPE'"),
        "observation_lookup": _q("select id, model_id, metric_id, as_of, num from obs where id = 'obs_7_quantity_1997q3_actual_2'"),
        "queue_order": _q("select model_id, id, row_number() over (partition by model_id order by attention_level <> 'action_required', coalesce(model_name, ''), replace(coalesce(sheet, ''), '_', ' '), row nulls last, replace(id, '_', ' '))::INT as n from queue", _QUEUE),
        "attention_unassigned": _q("select id, model_id from queue where attention_level = 'action_required' and action_owner is null", _QUEUE),
        "confirmed_item": _q("select case when id = f then 'resolved' else status end as status, attention_level, count(*) as n from items, (select min(id) as f from items where status = 'open' and attention_level = 'needs_review') group by 1, 2", _REVIEW),
        "history_fold": """with ev as (select user_id, ts, event_id, case when event_type in ('purchase', 'click') then 'commit' when event_type = 'error' then 'undo' when event_type = 'view' then 'redo' else 'reset' end as a from events),
            f as (select user_id, list_reduce(list_prepend({'p': []::BIGINT[], 'x': 0::BIGINT, 'f': []::BIGINT[], 'a': ''}, list({'p': []::BIGINT[], 'x': event_id::BIGINT, 'f': []::BIGINT[], 'a': a} order by ts, event_id)),
              lambda s, n: case when n.a = 'commit' and n.x <> s.x then {'p': list_append(s.p, s.x)[-20:], 'x': n.x, 'f': []::BIGINT[], 'a': ''}
                when n.a = 'undo' and len(s.p) > 0 then {'p': s.p[:len(s.p) - 1], 'x': s.p[len(s.p)], 'f': list_prepend(s.x, s.f), 'a': ''}
                when n.a = 'redo' and len(s.f) > 0 then {'p': list_append(s.p, s.x), 'x': s.f[1], 'f': s.f[2:], 'a': ''}
                when n.a = 'reset' then {'p': []::BIGINT[], 'x': 0::BIGINT, 'f': []::BIGINT[], 'a': ''} else s end) as s from ev group by 1)
            select user_id, s.x as present, len(s.p)::INT as n_past, len(s.f)::INT as n_future from f""",
        "navigation_fold": """with ev as (select user_id, ts, event_id, case when event_type in ('purchase', 'click', 'view') then 'inspect' when event_type = 'error' then 'back' when event_id % 5 = 0 then 'close' else 'replace' end as a, event_id % 3 as v from events),
            f as (select user_id, list_reduce(list_prepend({'p': []::BIGINT[], 'x': null::BIGINT, 'a': ''}, list({'p': []::BIGINT[], 'x': v::BIGINT, 'a': a} order by ts, event_id)),
              lambda s, n: case when n.a = 'inspect' and s.x is not null and s.x <> n.x then {'p': list_append(s.p, s.x)[-24:], 'x': n.x, 'a': ''}
                when n.a = 'inspect' then {'p': s.p, 'x': n.x, 'a': ''} when n.a = 'replace' then {'p': []::BIGINT[], 'x': n.x, 'a': ''}
                when n.a = 'back' and len(s.p) > 0 then {'p': s.p[:len(s.p) - 1], 'x': s.p[len(s.p)], 'a': ''}
                when n.a = 'close' then {'p': []::BIGINT[], 'x': null::BIGINT, 'a': ''} else s end) as s from ev group by 1)
            select user_id, s.x as target, len(s.p)::INT as n_history from f""",
        "dependent_reach": _q("select id from all_obs where metric_id = 'metric_discount_amount' union select dependent_id from deps where id in (select id from all_obs where metric_id = 'metric_discount_amount') union select d2.dependent_id from deps d1 join deps d2 on d2.id = d1.dependent_id where d1.id in (select id from all_obs where metric_id = 'metric_discount_amount')", _INPUTS),
        "eval_errors": _q("select out_id, 'cannot resolve metric_gross_revenue for ' || coalesce(p.label, 'the requested period') as error from (select out_id, arg_min(in_period, ref) as in_period from (select out_id, ref, in_period from inputs where transformation_id = 'transformation_growth' and in_id is null) group by 1) left join periods p on p.id = in_period", _INPUTS),
        "edit_provenance": _q("select target_id, cell, case when target_id in (select id from ed union all select out_id from moved) then 'corrected' else review_status end as review_status from records", _REVIEW + ", " + _EVAL + _EDIT),
        "metric_hierarchy": _q("select model_id, metric_id, parent_id, depth::INT as depth, array_to_string(path, '.') as path from tree", _TREE, True),
        "hierarchy_below": _q("select s.model_id, s.metric_id, case when s.metric_id <> 'metric_net_revenue' then 'metric_net_revenue' end as parent_id, (s.metric_id <> 'metric_net_revenue')::INT as depth from seen s where s.metric_id in ('metric_net_revenue', 'metric_net_margin', 'metric_growth')", _TREE, True),
        "inspector_format": _format(True),
        "number_format": _format(False),
        "expr_sum": "select l_orderkey, l_linenumber, l_quantity + l_tax + 0.25 - case when l_quantity = 7 then -1 else l_discount end as num, null::VARCHAR as error from lineitem",
        "expr_issues": _CATALOG + "select id, list_extract([null, null, null, null, '$.arguments[1]', null, '$.callee', '$', '$', null], (k % 10 + 1)::INT) as path, list_extract([null, null, null, null, 'name b is not allowed', null, 'function foo is not allowed', 'operator && is not allowed', 'cannot be parsed: unexpected end', null], (k % 10 + 1)::INT) as reason from plain where status = 'supported' and k % 10 in (4, 6, 7, 8)",
        "formula_references": _CATALOG + ", steps(d, n, step) as (values (0, 1, 1), (1, 1, 1), (2, 1, 1), (2, 2, -2), (3, 1, 1), (4, 1, 1), (5, 1, 1), (6, 1, 1), (9, 1, 1), (9, 2, -4)), r as (select id, 'metric_' || (k + step) as metric_id, d from formulas join steps on d = k % 10 where status = 'supported') select id as transformation_id, metric_id || case d when 3 then '|-1' when 5 then '|period:period_x' else '|0' end as ref, metric_id, case d when 3 then -1 else 0 end::INT as offset, (row_number() over (partition by id order by metric_id) - 1)::INT as dependency from r",
        "formula_cycle_paths": _CATALOG + f"select object_id as metric_id, 'metric_' || k || ' -> metric_' || (k + 1) || ' -> metric_' || (k + 2) || ' -> metric_' || k as path from ({_CYCLE_OF_THREE})",
        "cell_cycle_paths": _q("select model_id, 'metric_discount_amount' as metric_id, 'metric_discount_amount[' || period_id || '] -> metric_net_revenue[' || period_id || '] -> metric_discount_amount[' || period_id || ']' as path from ring", _CYCLIC),
        "strong_components": "with back as (select p_partkey as high, p_partkey - p_size % 5 as low from part where p_size % 4 = 0 and p_partkey >= p_size % 5), cover as (select p_partkey as id, exists (select 1 from back where low <= p_partkey and p_partkey < high) as joined, exists (select 1 from back where low <= p_partkey and p_partkey <= high) as inside from part), runs as (select id, inside, sum(case when joined then 0 else 1 end) over (order by id rows between unbounded preceding and 1 preceding) as run from cover) select id, max(id) over (partition by coalesce(run, 0)) as component from runs where inside",
        "metric_search": "select 'metric_' || p_partkey as id, p_name as name from part where contains(lower(p_name), 'widget') or contains(lower('metric_' || p_partkey), 'widget') or contains(lower(p_type), 'widget') or contains(lower(p_brand), 'widget')",
        "expr_nested": _NESTED,
        "distinct_records": "with r as (select l_returnflag, case when l_linenumber < 6 then l_linenumber end as l_linenumber, l_quantity, min(l_orderkey) as l_orderkey from lineitem group by 1, 2, 3) select *, row_number() over (order by l_orderkey, case when l_linenumber is null then '' else '{\"l_linenumber\":' || l_linenumber || ',' end || case when l_linenumber is null then '{' else '' end || '\"l_quantity\":' || l_quantity || ',\"l_returnflag\":\"' || l_returnflag || '\"}') as record from r",
        "extracted_observations": _EXTRACTED + "select path, 'model_' || path as model_id, 'observation_' || m || '_' || n as id, 'metric_' || m as metric_id, 'period_' || n as period_id, case when n >= 3 then 'scenario_base' end as scenario_id, 'number' as kind, round(case c when 'B' then q when 'C' then t when 'D' then q * 2 else case when t = 0 then 7 else q / t end end, 6) as num, case when e is not null then 'derived' when n < 3 then 'reported' else 'assumption' end as value_type, transformation_id from y where state is null",
        "extracted_items": _EXTRACTED + "select path, 'unresolved_' || state || '_' || m || '_' || n as id, 'source_error' as category, 'metric_' || m as target_id, sheet, c || n as cell, 'source_owner' as action_owner from y where state is not null",
        "extracted_transformations": _EXTRACTED + "select path, transformation_id as id, 'metric_' || m as output_metric_id, 'supported' as status, e as expression, count(*)::INT as n_sources, string_agg('period_' || n, ',' order by 'period_' || n) as periods from y where state is null and e is not null group by all",
        "package_items": """with i as (
            select 'package_' || user_id % 97 as path, 'item_' || event_id as id, event_id as e, event_id % 4 <> 3 as open, case when event_id % 5 < 2 then 'ACTION REQUIRED' else 'NEEDS REVIEW' end as label,
                   event_type || ' of user ' || user_id || ' at ' || event_id as text from events),
          l as (select path, e, '- ' || case when e % 7 = 0 then 'NOTE' else label end || ' `' || id || '`: ' || case when e % 6 = 0 then 'other' else text end as line from i where e % 10 <> 0),
          r as (select path, string_agg(line, ' ' order by e) as report from l group by 1),
          s as (select i.path, i.id, bool_or(contains(line, label)) as labelled from i left join l on l.path = i.path and contains(line, i.id) where open group by 1, 2)
          select path, case when labelled is null then 'item_not_recorded' else 'item_label' end as issue, id as object_id from s where labelled is null or not labelled
          union all select i.path, 'item_text', id || '/description' from i join r using (path) where not contains(report, text)""",
        "sum_if": _sums("coalesce(sum(v) filter (same), 0)"),
        "average_if": _sums("avg(v) filter (same)"),
        "style_roles": "select l_returnflag as role, case when l_linenumber % 2 = 0 then 'input' else 'none' end as kind, count(*) as n from lineitem group by all union all select l_returnflag, null, count(*) from lineitem group by 1",
        "blockers_by_metric": "with c as (select 'metric_' || l_orderkey % 20 as output_metric_id, case when l_linenumber < 4 then 'unmapped_cells' else 'unsupported_range' end as reason, case when l_linenumber <> 3 then 'Model!B' || l_quantity::INT end as input from lineitem), d as (select *, count(*) as k from c group by all), r as (select *, row_number() over (partition by output_metric_id, reason order by input nulls last) as i from d) select output_metric_id, reason, sum(k)::BIGINT as n, count(input) as n_inputs, coalesce(string_agg(input, ',' order by input) filter (i <= 12), '') as first_inputs from r group by 1, 2",
        "sections_in_several": "select o_custkey, count(distinct o_orderpriority) as n from orders group by 1 having count(distinct o_orderpriority) > 1",
        "sections_not_covered": "select distinct c_custkey as custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')",
        "task_matches": "with l as (select 'transformation_' || l_orderkey % 50 as t, 'period_' || l_quantity::INT as p, * from lineitem), a as (select t, p, count(*) as n from l where l_linenumber = 3 and l_orderkey % 3 = 0 group by 1, 2), b as (select distinct t, p from l where l_linenumber = 2 and l_orderkey % 5 = 0) select coalesce(a.t, b.t) as transformation_id, coalesce(a.p, b.p) as period_id, case when a.t is null then 'missing_task' when b.t is null then 'unknown_task' else 'repeated_task' end as issue from a full join b on a.t = b.t and a.p = b.p where a.t is null or b.t is null or n > 1",
        "entities_with_data": _q("select distinct model_id, entity_id, n_name as name, n_nationkey::BIGINT as ord from obs join nation on entity_id = 'entity_nation_' || n_nationkey"),
        "period_modes": _q("select model_id, entity_id, period_id, mode, coalesce(lag(mode) over (partition by model_id, entity_id order by period_key) <> mode, false) as boundary from (select model_id, entity_id, period_id, period_key, arg_min(actuality, metric_ord) as mode from fin group by 1, 2, 3, 4)", _TABLE),
        "object_index": _q("select 'model_' || replace(lower(r_name), ' ', '_') as id, 'models' as collection, r_name as label from region union all select 'entity_nation_' || n_nationkey, 'entities', n_name from nation union all select id, 'metrics', name from metrics union all select id, 'periods', label from periods union all select id, 'transformations', id from transformations union all select id, 'relationships', id from relationships union all select 'scenario_' || x, 'scenarios', 'scenario_' || x from (values ('base'), ('bull'), ('bear')) t(x)"),
        "relationships_both_ways": _q("select target_id, relationship_id, type, direction, other_id, m.name as other_label from (select from_id as target_id, id as relationship_id, type, 'outgoing' as direction, to_id as other_id from relationships union all select to_id, id, type, 'incoming', from_id from relationships where from_id <> to_id) join metrics m on m.id = other_id"),
        "period_axis": _q("select model_id, entity_id, version_id, out_as_of, out_scenario, period_type, period_id, pos::INT as pos from axis", _AXIS),
        "resolve_inputs": _q("select out_id, ref, in_period, in_id, num from inputs", _INPUTS),
        "direct_dependents": _q("select id, dependent_id from deps", _INPUTS),
        "transitive_dependents": _q("select id, max(level)::INT as level from walk group by 1", _INPUTS + ", walk as (select id, 0 as level from all_obs where metric_id = 'metric_gross_revenue' union all select dependent_id, level + 1 from walk join deps using (id))", True),
        "eval_net_revenue": _q("select out_id, 'number' as kind, net as num, null::VARCHAR as error from net", _EVAL),
        "eval_all": _q("select o.id, case when e.num is null then 'null' else 'number' end as kind, e.num from all_obs o left join evaluated e using (id) where transformation_id is not null", _EVAL),
        "edit_propagation": _q("select id, true as direct, num as before, num + 1000 as after from ed union all select out_id, false, before, after from moved", _EVAL + _EDIT),
        "forest_depth": "with recursive it as (select p_brand as g, p_partkey as id, case when p_partkey % 5 > 0 then (p_partkey // 5) * 5 + p_size % 3 end as pa from part), e as (select i.g, i.id, p.id as up from it i left join it p on p.g = i.g and p.id = i.pa and p.id < i.id), w as (select g, id, 0 as depth from e where up is null union all select e.g, e.id, depth + 1 from e join w on w.g = e.g and w.id = e.up) select g as \"group\", id, depth::INT as depth from w",
        "parent_issues": "with it as (select p_brand as g, p_partkey as id, p_partkey * 7 % 1000 as pa from part) select i.g as \"group\", i.id, case when p.id is null then 'unknown_parent' else 'parent_order' end as issue from it i left join it p on p.g = i.g and p.id = i.pa where p.id is null or p.id >= i.id",
        "component_cycles": "with recursive f as (select s_suppkey as id, (s_suppkey * s_suppkey + 1) % 101 as p from supplier), w as (select id as start, p as here, 1 as n from f union all select start, f.p, n + 1 from w join f on f.id = here where here <> start and n <= 101) select low as cycle, count(*) as size from (select c.start, min(w.here) as low from (select distinct start from w where here = start) c join w using (start) group by 1) group by 1",
        "hidden_ranges": "select l_suppkey, min(k) as first, max(k) as last from (select l_suppkey, k, k - row_number() over (partition by l_suppkey order by k) as run from (select distinct l_suppkey, l_orderkey as k from lineitem where l_returnflag = 'R')) group by l_suppkey, run",
        "expr_arithmetic": f"select l_orderkey, l_linenumber, case when t then 'null' when x is null then 'number' else 'number' end as kind, case when t or l_quantity = 25 then null else {_round(f'l_quantity / {quarter}', 3)} end as num, null::VARCHAR as error from (select *, l_quantity - 25 + -l_tax * 100 = 0 as t, 1 as x from lineitem) where not (l_quantity = 25 and not t) union all select l_orderkey, l_linenumber, null, null, 'round() requires a finite number' from lineitem where l_quantity = 25 and not (l_quantity - 25 + -l_tax * 100 = 0)",
        "expr_round": f"select l_orderkey, l_linenumber, floor({quarter} / 2 + 0.5) + floor(l_tax * l_extendedprice * k + 0.5) / k * 1000 as num from (select *, pow(10.0, l_quantity % 4 - 1) as k from lineitem)",
        "expr_mod": f"select l_orderkey, l_linenumber, case when d <> 0 then {quarter} - d * floor({quarter} / d) end as num, case when d = 0 then 'mod() divisor must not be zero' end as error from (select *, case when l_quantity > 40 then -7.0 when l_quantity > 38 then 0.0 else 7.0 end::DOUBLE as d from lineitem)",
        "expr_minmax": "select l_orderkey, l_linenumber, round(greatest(least(l_quantity, 30, l_discount * 100), abs(l_quantity - 40)) + (3 + l_quantity) / 3, 6) as num from lineitem",
        "expr_when": "select l_orderkey, l_linenumber, case when l_quantity = 50 then null when l_returnflag = 'R' or l_quantity < 30 then 'string' else 'null' end as kind, case when l_quantity = 50 then null when l_returnflag = 'R' then 'R' when l_quantity < 30 then 'small' end as str, case when l_quantity = 50 then '+ requires a finite number' end as error from lineitem",
        "locator_parse": "with c as (select l_orderkey, l_linenumber, replace('$' || list_extract(['a', 'B', 'aa', 'ZZ', '', 'Ab1x', 'c'], l_linenumber) || '$' || l_orderkey % 1000, '$', '') as cell from lineitem), p as (select *, nullif(upper(regexp_extract(cell, '^([A-Za-z]+)[0-9]+', 1)), '') as col from c) select l_orderkey, l_linenumber, try_cast(nullif(regexp_extract(cell, '^[A-Za-z]+([0-9]+)', 1), '') as BIGINT) as row, col as \"column\", case length(col) when 1 then ascii(col) - 64 when 2 then (ascii(col[1]) - 64) * 26 + ascii(col[2]) - 64 end::BIGINT as number from p",
        "formula_kind": f"select l_orderkey, l_linenumber, case when l_orderkey % 5 = 0 or l_orderkey % 7 = 0 then 'expression' when f in ('=1+2', '= 50%*2', '=1.5e3/2', '=(2-1)^2') then 'constant' else 'expression' end as formula_kind from (select *, {_FORMULA} as f from lineitem)",
        "unique_lookup": "select l_orderkey, min(l_returnflag) as l_returnflag from lineitem group by 1 having count(distinct l_returnflag) = 1",
        "transformation_dedup": "with c as (select 'metric_' || o_custkey % 50 as m, lower(o_orderstatus) as s, 'ref(''m'') * ' || o_orderkey % 3 as e, strftime(o_orderdate, '%Y%m') as p, '=B' || o_orderkey % 2 as f from orders), d as (select m, s, e, p, count(distinct f) > 1 as c, min(f) as f from c group by 1, 2, 3, 4) select 'transformation_' || left(sha256(m || chr(0) || s || chr(0) || e), 8) as id, m as output_metric_id, e as expression, count(*) as n_periods, bool_or(c) as conflict, string_agg(p || f, ',' order by p) as sources from d group by m, s, e",
        "context_ids": "select o_orderstatus, o_orderpriority, first, row_number() over (order by first, o_orderstatus, o_orderpriority)::INT as number from (select o_orderstatus, o_orderpriority, min(o_orderkey) as first from orders group by 1, 2)",
        "function_histogram": "select name, count(*) as n from (select unnest(regexp_extract_all(upper('=Sum(A1)+' || list_extract(['IF(B1>2,1,0)', 'sum(B2)*Round(C1,2)', 'AVERAGE.IF(A1)', '2', 'IFERROR(SUM(A2),0)', 'MAX(1,2)', 'x'], l_linenumber)), '([A-Z][A-Z0-9.]*)\\(', 1)) as name from lineitem) group by 1",
        "workbook_inventory": f"select 'book' || l_orderkey % 100 as path, 'S' || l_orderkey as sheet, count(*) * 8 as stored, count(*) * 8 - count(*) filter (n % 3 = 0) as non_empty, count(*) * 5 as formulas, count(*) filter (n % 5 <> 0) as external, count(distinct n % 2) * 8 as styles from {_SHEET_ROWS} group by l_orderkey",
        "formula_translation": f"""select 'book' || l_orderkey % 100 as path, 'S' || l_orderkey as sheet, upper(c) || n as cell, 'metric_' || c as metric_id, 'period_' || n as period_id,
            case when c = 'd' and n <> 4 then 'ref(''metric_b'') * 2' when c = 'e' then '(ref(''metric_c'') == 0 ? 7 : ref(''metric_b'') / ref(''metric_c''))' when c = 'f' then 'sum(ref(''metric_b''), ref(''metric_c''))' when c = 'h' then 'when(ref(''metric_b'') > 25, ref(''metric_c''), 0)' end as expression,
            case when c = 'd' and n <> 4 then 'metric_b' when c in ('e', 'f', 'h') then 'metric_b,metric_c' else '' end as dependencies,
            case when c = 'g' then 'unmapped_sheet' when c = 'd' and n = 4 then 'syntax_or_replay' end as blocker from {_SHEET_ROWS}, (values ('d'), ('e'), ('f'), ('g'), ('h')) t(c)""",
        "formula_blockers": f"""select 'book' || l_orderkey % 100 as path, 'S' || l_orderkey as sheet, c || n as cell,
            case when c = 'D' then 'ref(''metric_b'') * 2' when c = 'J' then 'ref(''metric_b'') * 2' when c = 'I' and ahead is null and l_quantity = 0 then '0 * 1' end as expression,
            case when c in ('D', 'J') or (c = 'I' and ahead is null and l_quantity = 0) then null when c = 'K' then 'unmapped_sheet' when c in ('E', 'F', 'H') then 'unmapped_period' when c = 'I' and ahead is not null then 'unmapped_metric' when c = 'G' then 'unmapped_sheet' else 'syntax_or_replay' end as blocker
            from (select *, lead(n) over (partition by l_orderkey order by n) as ahead from {_SHEET_ROWS}), (values ('D'), ('E'), ('F'), ('G'), ('H'), ('I'), ('J'), ('K')) t(c) where n % 2 = 1""",
        "shared_formula_shift": "select l_orderkey, l_linenumber, '=SUM($A$1:' || chr((66 + l_linenumber)::INT) || (2 + l_orderkey % 5) || ')&\"C3\"+' || chr((67 + l_linenumber)::INT) || '$3' as shifted from lineitem",
        "provenance_resolved": _q("select * from prov", _REVIEW),
        "unreviewed_counts": _q("select model_id, count(*) as n_unreviewed from prov join all_obs on id = target_id where review_status = 'unreviewed' group by 1", _REVIEW),
        "attention_queue": _q("select * exclude (model_name) from queue", _QUEUE),
        "attention_by_owner": _q("select case when attention_level = 'needs_review' then 'needs_review' else coalesce(action_owner, 'unassigned') end as bucket, count(*) as n from queue group by 1", _QUEUE),
        "navigation_target": _q("select o.id, p.id as presentation_id from all_obs o join shown s using (metric_id) join presentations p on p.id = s.presentation_id and p.model_id = o.model_id left join records r on r.target_id = o.id qualify row_number() over (partition by o.id order by coalesce(r.sheet = p.sheet, false) desc, (p.id = 'presentation_model_asia_2') desc, p.ord) = 1", _REVIEW),
    } | {f"validate_{k}": v for k, v in RULES.items()}
