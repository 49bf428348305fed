"""The catalogue's queries in SQL, for cross-checking on another engine.

Each text is independent of the Spark code: range lookups are plain ``between``
joins, picks are brute force over all candidates, windows span whole series.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}
QUERY_SQL: dict[str, str] = {}

# Bridge views -------------------------------------------------------------------

VIEWS["b_topology"] = """
select cast(row_number() over (order by md5(seg)) as int) topology_id, seg topology_key
from (select distinct c_mktsegment seg from customer) q"""

VIEWS["b_live"] = """
select distinct c_mktsegment topology_key from customer where c_mktsegment <> 'BUILDING'"""

VIEWS["b_traffic"] = """
select t.topology_id, cast(l.l_suppkey as int) source_task,
       cast(100000 + c.c_custkey as int) destination_task, cast(count(*) as int) traffic
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
join customer c on o.o_custkey = c.c_custkey
join b_topology t on t.topology_key = c.c_mktsegment
group by 1, 2, 3"""

VIEWS["b_task_load"] = """
select t.topology_id, cast(u.task as int) task, cast(sum(u.q) as bigint) q from (
  select c.c_mktsegment seg, l.l_suppkey task, l.l_quantity q
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey
  join customer c on o.o_custkey = c.c_custkey
  union all
  select c.c_mktsegment, 100000 + c.c_custkey, l.l_quantity
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey
  join customer c on o.o_custkey = c.c_custkey
) u join b_topology t on t.topology_key = u.seg
group by 1, 2"""

VIEWS["b_load"] = """
select g.topology_id, g.begin_task, g.end_task, g.ld as load, n.n_name node
from (
  select topology_id,
         case when task < 100000 then task // 4 else 1000000 + task // 50 end b,
         min(task) begin_task, max(task) end_task, cast(sum(q) as bigint) ld
  from b_task_load group by 1, 2
) g join nation n on n.n_nationkey = g.b % 25"""

VIEWS["b_node"] = """
select n_name as name,
       cast((select cast(sum(load) as bigint) from b_load) * (n_nationkey + 1) // 325 as bigint) capacity,
       cast(1 + n_nationkey % 8 as int) cores
from nation"""

VIEWS["b_exec_slot"] = """
select topology_id, begin_task, end_task, load,
       cast((begin_task // 4) % (2 + 2 * topology_id) as int) slot_id,
       'c' || (begin_task % 5) component
from b_load"""

VIEWS["b_slot_node"] = """
select distinct x.topology_id, x.slot_id, n.n_name node
from b_exec_slot x join nation n on n.n_nationkey = (x.slot_id // 2 * 3 + x.topology_id) % 25"""

VIEWS["b_params"] = """
select e.topology_id, cast(3 + 2 * e.topology_id as int) workers, e.executor_count, e.total_load,
       case when e.topology_id % 2 = 0 then cast(0 as float)
            else cast(e.topology_id / 10.0 as float) end alfa,
       case when e.topology_id % 3 = 0 then cast(1 as float)
            else cast((e.topology_id % 4) / 4.0 as float) end beta,
       cast(1 + e.topology_id / 10.0 as float) gamma,
       case when e.topology_id = 4 then cast(0 as float)
            else cast(e.topology_id / 10.0 as float) end delta
from (select topology_id, cast(count(*) as int) executor_count, cast(sum(load) as bigint) total_load
      from b_load group by 1) e"""

VIEWS["b_limits"] = """
with a as (
  select *, least(workers, executor_count) sc,
         least((select count(*) from b_node), least(workers, executor_count)) n
  from b_params
), c as (
  select *, cast(ceil(n_lo + ceil(beta * cast(n - n_lo as float))) as int) use_n from (
    select *, cast(ceil(cast(sc as double) / n) as int) n_lo,
           cast(ceil(cast(executor_count as double) / sc) as int) e_lo from a) q
)
select topology_id, cast(sc as int) slot_count,
       cast(e_lo + ceil(alfa * cast(executor_count - sc + 1 - e_lo as float)) as int) max_executors,
       cast(trunc(gamma * cast(total_load // sc as float)) as bigint) max_load,
       use_n as nodes_to_use,
       cast(ceil(cast(sc as double) / use_n)
            + ceil(cast(delta as double)
                   * (sc - use_n + 1 - ceil(cast(sc as double) / use_n))) as int) max_slots
from c"""

VIEWS["b_slots"] = """
select topology_id, cast(unnest(range(0, slot_count)) as int) slot_id from b_limits"""

VIEWS["b_occupancy"] = """
select topology_id, slot_id, cast(count(*) as int) executors, cast(sum(load) as bigint) load
from b_exec_slot group by 1, 2"""

VIEWS["b_state"] = """
select s.topology_id, s.slot_id, coalesce(o.executors, 0) executors, coalesce(o.load, 0) load,
       l.max_executors, l.max_load
from b_slots s left join b_occupancy o using (topology_id, slot_id) join b_limits l using (topology_id)"""

VIEWS["b_ports"] = """
select n.n_name as name, cast(s_suppkey % 7 as int) port, s_suppkey % 2 = 0 as used
from supplier join nation n on n.n_nationkey = s_nationkey"""

VIEWS["b_free"] = """
select name, count(distinct port) free_ports from b_ports where not used group by 1"""

VIEWS["b_node_state"] = """
select n.name, n.capacity, cast(coalesce(u.slots, 0) as int) slots, coalesce(u.load, 0) load,
       cast(coalesce(p.ports, 0) as int) ports,
       cast(coalesce(p.ports, 0) - coalesce(u.slots, 0) as int) free_ports
from b_node n
left join (select node, count(*) slots, cast(sum(load) as bigint) load
           from b_slot_node join b_occupancy using (topology_id, slot_id) group by 1) u on u.node = n.name
left join (select name, count(distinct port) ports from b_ports group by 1) p on p.name = n.name"""

VIEWS["b_on_node"] = """
select node, topology_id, cast(count(*) as int) slots from b_slot_node group by 1, 2"""

VIEWS["b_receipts"] = """
select event_type topology_key, ts, event_id, cast(user_id as int) source_task,
       cast(json_extract_string(props, '$.k') as int) destination_task
from events"""

VIEWS["b_cpu"] = """
select user_id thread_id, ts, event_id,
       cast(2000 * sum(cast(round(value * 100) as bigint))
            over (partition by user_id order by ts, event_id) as bigint) cpu_total
from events"""

VIEWS["b_cycles"] = """
select thread_id, ts, event_id, cpu_total,
       cast(trunc(cast(cpu_total - coalesce(lag(cpu_total) over w, 0) as double) / 1e9
                  * 2000000000.0::double) as bigint) cycles
from b_cpu window w as (partition by thread_id order by ts, event_id)"""

VIEWS["b_cores"] = """
select s_name host, p.processor, 'M' || s_nationkey model_name,
       cast(((p.processor + 1) * 1000 + s_suppkey) * 1048576 as bigint) speed_hz
from supplier, (values (0), (1)) p(processor)"""

VIEWS["b_hosts"] = """
select host, cast(count(*) as int) cores, cast(sum(speed_hz) as bigint) total_hz from b_cores group by 1"""

VIEWS["b_snapshot"] = """
select distinct cast(ts as date) snapshot, event_type host, cast(user_id % 2 as int) port,
       'c' || ((event_id % 3 + date_diff('day', date '1970-01-01', cast(ts as date)) // 2) % 5) executor
from events"""

VIEWS["b_slot_text"] = """
select snapshot, host, port, string_agg(executor, ', ' order by executor) executors
from b_snapshot group by 1, 2, 3"""

VIEWS["b_snapshot_text"] = """
select snapshot, string_agg('(' || host || ':' || port || ' ' || executors || ')', '' order by host, port) assignment
from b_slot_text group by 1"""

VIEWS["b_changes"] = """
select snapshot from (
  select snapshot, assignment, lag(assignment) over (order by snapshot) before from b_snapshot_text
) q where before is null or before <> assignment"""

VIEWS["b_eval"] = """
select event_type topology_key, event_id, ts eval_ts,
       cast(round(value * 100) as bigint) current_traffic,
       cast(round(value * 100) as bigint) * (event_id % 100) // 100 as best_traffic,
       event_id % 11 = 0 as relieves_overload
from events"""

VIEWS["b_edge"] = """
select t.topology_id, t.source_task, t.destination_task, t.traffic,
       s.begin_task src_begin, s.end_task src_end, d.begin_task dst_begin, d.end_task dst_end,
       s.node src_node, d.node dst_node
from b_traffic t
left join b_load s on s.topology_id = t.topology_id and t.source_task between s.begin_task and s.end_task
left join b_load d on d.topology_id = t.topology_id
                  and t.destination_task between d.begin_task and d.end_task"""

VIEWS["b_pairs"] = """
select topology_id, src_begin, src_end, dst_begin, dst_end, cast(sum(traffic) as bigint) traffic
from b_edge group by all"""

VIEWS["b_placed"] = """
select p.*, s.slot_id src_slot, d.slot_id dst_slot, s.load src_load, d.load dst_load
from b_pairs p
join b_exec_slot s on s.topology_id = p.topology_id and s.begin_task = p.src_begin and s.end_task = p.src_end
join b_exec_slot d on d.topology_id = p.topology_id and d.begin_task = p.dst_begin and d.end_task = p.dst_end"""

VIEWS["b_slot_pairs"] = """
select topology_id, least(src_slot, dst_slot) slot_a, greatest(src_slot, dst_slot) slot_b,
       cast(sum(traffic) as bigint) traffic
from b_placed where src_slot <> dst_slot group by 1, 2, 3"""

VIEWS["b_slot_pairs_placed"] = """
select p.*, a.node node_of_a, b.node node_of_b
from b_slot_pairs p
join b_slot_node a on a.topology_id = p.topology_id and a.slot_id = p.slot_a
join b_slot_node b on b.topology_id = p.topology_id and b.slot_id = p.slot_b"""

VIEWS["b_node_pairs"] = """
select least(node_of_a, node_of_b) node_a, greatest(node_of_a, node_of_b) node_b,
       cast(sum(traffic) as bigint) traffic
from b_slot_pairs_placed where node_of_a <> node_of_b group by 1, 2"""

VIEWS["b_affinity"] = """
select topology_id, begin_task, end_task, slot_id, cast(sum(traffic) as bigint) affinity from (
  select topology_id, src_begin begin_task, src_end end_task, dst_slot slot_id, traffic
  from b_placed where src_begin <> dst_begin
  union all
  select topology_id, dst_begin, dst_end, src_slot, traffic from b_placed where src_begin <> dst_begin
) q group by 1, 2, 3, 4"""

VIEWS["b_slot_affinity"] = """
select topology_id, slot_id, node, cast(sum(traffic) as bigint) affinity from (
  select topology_id, slot_a slot_id, node_of_b node, traffic from b_slot_pairs_placed
  union all
  select topology_id, slot_b, node_of_a, traffic from b_slot_pairs_placed
) q group by 1, 2, 3"""

VIEWS["b_cut"] = """
select topology_id, cast(sum(traffic) as bigint) traffic from b_slot_pairs group by 1"""

VIEWS["b_proposed"] = """
select x.topology_id, x.begin_task, x.end_task, x.load, s.node
from b_exec_slot x left join b_slot_node s using (topology_id, slot_id)"""

VIEWS["b_cross_proposed"] = """
select t.traffic from b_traffic t
join b_proposed s on s.topology_id = t.topology_id and t.source_task between s.begin_task and s.end_task
join b_proposed d on d.topology_id = t.topology_id and t.destination_task between d.begin_task and d.end_task
where s.node <> d.node"""

VIEWS["b_over"] = """
select n.name, cast(sum(l.load) as bigint) total_load, n.capacity, n.cores
from b_load l join b_node n on n.name = l.node
group by n.name, n.capacity, n.cores having sum(l.load) > n.capacity"""

VIEWS["b_over_proposed"] = """
select n.name from b_proposed l join b_node n on n.name = l.node
group by n.name, n.capacity having sum(l.load) > n.capacity"""

VIEWS["b_relieved"] = """
select o.name, o.capacity, o.total_load current_load, coalesce(p.load, 0) proposed_load,
       p.load is null as absent, coalesce(o.total_load > p.load, false) relieved
from b_over o left join (select node, cast(sum(load) as bigint) load from b_proposed group by 1) p
on p.node = o.name"""


# Sources and latest-value tables --------------------------------------------------

QUERY_SQL["scan_tables"] = """
select 'topology' table_name, count(*) row_count, cast(sum(topology_id) as bigint) checksum from b_topology
union all select 'load', count(*), cast(sum(load) as bigint) from b_load
union all select 'traffic', count(*), cast(sum(traffic) as bigint) from b_traffic
union all select 'node', count(*), cast(sum(capacity) as bigint) from b_node"""

QUERY_SQL["scan_cpuinfo"] = "select host, processor, model_name, speed_hz from b_cores"

QUERY_SQL["sink_assignment_append"] = """
select strftime(snapshot, '%Y-%m-%d') || ' 00:00:00' as time, t.topologies, assignment
from b_changes join b_snapshot_text using (snapshot)
join (select snapshot, string_agg(k, ', ' order by k) topologies
      from (select distinct cast(ts as date) snapshot, 'T' || (user_id % 4) k from events) q
      group by 1) t using (snapshot)"""

QUERY_SQL["upsert_load"] = """
select topology_id, begin_task, end_task,
       case when begin_task % 3 = 0 then load * 2 + 1 else load end load,
       case when begin_task % 3 = 0 then 'MOVED' else node end node
from b_load"""

QUERY_SQL["upsert_traffic"] = """
select topology_id, source_task, destination_task,
       cast(case when destination_task % 3 = 0 then traffic * 2 + 1 else traffic end as int) traffic
from b_traffic"""

QUERY_SQL["upsert_node"] = """
with known as (select * from b_node where name < 'NATION_2'),
incoming as (
  select n.n_name as name, cast(sum(total_hz) as bigint) // 100 * 80 capacity, cast(sum(cores) as int) cores
  from b_hosts join supplier on s_name = host join nation n on n.n_nationkey = s_nationkey group by 1
)
select coalesce(k.name, i.name) as name, coalesce(i.capacity + 100, k.capacity) capacity, coalesce(k.cores, i.cores) cores
from known k full join incoming i on i.name = k.name"""

QUERY_SQL["register_topology"] = """
with known as (select * from b_topology where topology_id <= 3),
fresh as (
  select topology_key from b_topology where topology_id > 3
  union select event_type from events
)
select topology_id, topology_key from known
union all
select cast((select max(topology_id) from known) + row_number() over (order by md5(topology_key)) as int), topology_key
from fresh"""

QUERY_SQL["purge_topologies"] = """
with keep as (select topology_id from b_topology join b_live using (topology_key))
select 'load' table_name, topology_id, count(*) row_count, cast(sum(load) as bigint) total
from b_load join keep using (topology_id) group by 2
union all
select 'traffic', topology_id, count(*), cast(sum(traffic) as bigint)
from b_traffic join keep using (topology_id) group by 2
union all
select 'topology', topology_id, count(*), cast(sum(topology_id) as bigint)
from b_topology join keep using (topology_id) group by 2"""

# Filters and predicates -----------------------------------------------------------

QUERY_SQL["filter_topology"] = """
select l.*, t.topology_key from b_load l join b_topology t using (topology_id)
where topology_key in ('AUTOMOBILE', 'MACHINERY')"""

QUERY_SQL["task_in_executor"] = """
select k.topology_id, k.task, k.task between l.begin_task and l.end_task as inside,
       k.task + 1 between l.begin_task and l.end_task as next_inside
from b_task_load k left join b_load l
on l.topology_id = k.topology_id and l.begin_task <= k.task and l.end_task >= k.task"""

QUERY_SQL["cross_placement_filter"] = """
select topology_id, source_task, destination_task, src_node, dst_node, traffic
from b_edge where src_node <> dst_node"""

QUERY_SQL["can_accept_slot"] = """
select a.topology_id, a.slot_id, a.begin_task, a.end_task, l.load x, 1 as k,
       s.max_executors - s.executors >= 1 and s.load + l.load <= s.max_load as can_accept
from b_affinity a join b_load l using (topology_id, begin_task, end_task)
join b_state s using (topology_id, slot_id)"""

QUERY_SQL["can_assign_node"] = """
select a.topology_id, a.slot_id, a.node, o.load,
       not exists (select 1 from b_slot_node h
                   where h.topology_id = a.topology_id and h.slot_id = a.slot_id and h.node = a.node)
       and n.free_ports > 0 and n.load + o.load <= n.capacity and coalesce(t.slots, 0) < l.max_slots as can_assign
from b_slot_affinity a join b_occupancy o using (topology_id, slot_id)
join b_node_state n on n.name = a.node
left join b_on_node t on t.topology_id = a.topology_id and t.node = a.node
join b_limits l on l.topology_id = a.topology_id"""

QUERY_SQL["empty_slots"] = """
select topology_id, slot_id from b_state where executors = 0"""

QUERY_SQL["used_slots"] = """
select topology_id, slot_id from b_state where executors > 0"""

VIEWS["b_conf"] = """
select cast(s_suppkey as bigint) conf_id, cast(s_suppkey % 120 as int) capacity_pct,
       cast(case when s_suppkey % 4 <> 0 then (s_suppkey % 13) / 10.0 else 0 end as float) alfa,
       cast(case when s_suppkey % 5 <> 0 then (s_suppkey % 12) / 10.0 else 1 end as float) beta,
       cast(case when s_suppkey % 3 <> 0 then (s_suppkey % 7 * 4) / 10.0 end as float) gamma,
       cast(case when s_suppkey % 6 <> 0 then (s_suppkey % 11) / 10.0 else 0 end as float) delta,
       cast(0.5 as float) epsilon,
       case when s_suppkey % 17 <> 0 then s_suppkey % 110 end improvement,
       cast(case when s_suppkey % 2 <> 0 then s_suppkey * 60 else 180 end as int) timeout_s
from supplier"""

QUERY_SQL["validate_params"] = """
select * from (
  select conf_id, concat_ws(', ',
    case when not alfa between 0 and 1 then 'alfa' end, case when not beta between 0 and 1 then 'beta' end,
    case when not delta between 0 and 1 then 'delta' end, case when gamma < 1 then 'gamma' end,
    case when not capacity_pct between 1 and 100 then 'capacity_pct' end,
    case when improvement is null or not improvement between 1 and 100 then 'improvement' end) broken
  from b_conf) q
where broken <> ''"""

QUERY_SQL["default_params"] = """
select conf_id, alfa, beta, gamma is null as no_gamma, delta, epsilon, timeout_s from b_conf"""

# Joins ----------------------------------------------------------------------------

QUERY_SQL["join_load_topology"] = """
select topology_key, begin_task, end_task, load from b_load join b_topology using (topology_id)"""

QUERY_SQL["resolve_task_executor"] = """
select k.topology_id, k.task,
       case when l.begin_task is null then 'none' else '[' || l.begin_task || ', ' || l.end_task || ']' end executor,
       l.begin_task is not null as resolved
from b_task_load k left join (select * from b_load where node <> 'NATION_5') l
on l.topology_id = k.topology_id and k.task between l.begin_task and l.end_task"""

QUERY_SQL["resolve_edge_executors"] = """
select topology_id, source_task, destination_task, traffic, src_begin, src_end, dst_begin, dst_end from b_edge"""

QUERY_SQL["join_load_node"] = """
select l.topology_id, l.begin_task, l.end_task, l.load, l.node, n.capacity, n.cores
from b_load l join b_node n on n.name = l.node"""

QUERY_SQL["match_executor"] = """
select l.*, x.component from b_load l join b_exec_slot x
on x.topology_id = l.topology_id and x.begin_task = l.begin_task and x.end_task = l.end_task
where x.begin_task % 7 <> 0"""

QUERY_SQL["executor_to_slot"] = """
select topology_id, begin_task, end_task, case when component = 'c2' then -1 else slot_id end slot_id
from b_exec_slot"""

QUERY_SQL["slot_to_node"] = """
select s.topology_id, s.slot_id, coalesce(n.node, 'none') node
from b_slots s left join b_slot_node n using (topology_id, slot_id)"""

QUERY_SQL["containing_slots"] = """
with kept as (select * from b_exec_slot where component <> 'c2')
select p.topology_id, src_begin, dst_begin,
       case when s.slot_id is null and d.slot_id is null then 0
            when s.slot_id is null or d.slot_id is null or s.slot_id = d.slot_id then 1 else 2 end n,
       case when s.slot_id is null and d.slot_id is null then '<empty list>'
            when s.slot_id is null or s.slot_id = d.slot_id then d.slot_id::varchar
            when d.slot_id is null then s.slot_id::varchar
            else least(s.slot_id, d.slot_id) || ', ' || greatest(s.slot_id, d.slot_id) end slots
from b_pairs p
left join kept s on s.topology_id = p.topology_id and s.begin_task = p.src_begin and s.end_task = p.src_end
left join kept d on d.topology_id = p.topology_id and d.begin_task = p.dst_begin and d.end_task = p.dst_end"""

QUERY_SQL["containing_nodes"] = """
with kept as (select * from b_slot_node where slot_id <> 2)
select p.topology_id, slot_a, slot_b,
       case when a.node is null and b.node is null then 0
            when a.node is null or b.node is null or a.node = b.node then 1 else 2 end n,
       case when a.node is null and b.node is null then '<empty list>'
            when a.node is null or a.node = b.node then b.node
            when b.node is null then a.node
            else least(a.node, b.node) || ', ' || greatest(a.node, b.node) end nodes
from b_slot_pairs p
left join kept a on a.topology_id = p.topology_id and a.slot_id = p.slot_a
left join kept b on b.topology_id = p.topology_id and b.slot_id = p.slot_b"""

QUERY_SQL["describe_assignment"] = """
select x.topology_id, n.node host, x.slot_id as port,
       x.component || '[' || x.begin_task || ',' || x.end_task || ']' executor
from b_exec_slot x join b_slot_node n using (topology_id, slot_id)"""

QUERY_SQL["upstream_slots"] = """
with inputs(component, input_component) as (
  values ('c1', 'c0'), ('c2', 'c0'), ('c3', 'c1'), ('c3', 'c2'), ('c4', 'c3')
), comp as (
  select t.topology_id, 'c' || i component, i as position from b_topology t, range(0, 5) r(i)
), base as (
  select c.topology_id, c.component, c.position, s.slot_id, s.executors,
         exists (select 1 from b_exec_slot x join inputs i on i.input_component = x.component
                 where i.component = c.component and x.topology_id = c.topology_id and x.slot_id = s.slot_id) fed
  from comp c join b_state s on s.topology_id = c.topology_id where s.executors < s.max_executors
)
select topology_id, component, slot_id,
       case when fed or (executors = 0 and position >= 2) then 'primary' else 'secondary' end slot_class,
       not fed and executors = 0 and position >= 2 as promoted
from base"""

QUERY_SQL["ports_per_host"] = "select name, ports from b_node_state"

# Aggregations -----------------------------------------------------------------------

QUERY_SQL["total_load"] = """
select t.topology_id, t.topology_key,
       cast(coalesce(sum(case when t.topology_key <> 'BUILDING' then l.load end), 0) as bigint) total_load
from b_topology t left join b_load l using (topology_id) group by 1, 2"""

QUERY_SQL["overloaded_nodes"] = "select * from b_over"

QUERY_SQL["executor_traffic"] = "select * from b_pairs"

VIEWS["b_broken"] = """
select distinct topology_id from b_edge where topology_id = 2 and (src_begin % 8 = 0 or dst_begin % 8 = 0)"""

QUERY_SQL["complete_topologies"] = """
select topology_id from b_topology where topology_id not in (select topology_id from b_broken)"""

QUERY_SQL["executor_traffic_complete_only"] = """
select * from b_pairs where topology_id not in (select topology_id from b_broken)"""

QUERY_SQL["inter_node_traffic"] = """
select cast(coalesce(sum(traffic), 0) as bigint) traffic from b_edge where src_node <> dst_node"""

QUERY_SQL["inter_node_traffic_by_topology"] = """
select topology_id, topology_key,
       cast(coalesce(sum(case when src_node <> dst_node then traffic end), 0) as bigint) traffic
from b_topology left join b_edge using (topology_id) group by 1, 2"""

QUERY_SQL["slot_traffic"] = "select * from b_slot_pairs"
QUERY_SQL["node_traffic"] = "select * from b_node_pairs"
QUERY_SQL["slot_traffic_total"] = "select * from b_cut"

QUERY_SQL["node_traffic_total"] = """
select case when (select count(*) from b_slot_node) > 0
            then cast(coalesce(sum(traffic), 0) as bigint) end traffic from b_node_pairs"""

QUERY_SQL["executor_ranges"] = """
select cast(source_task as bigint) thread_id, min(destination_task) begin_task, max(destination_task) end_task
from b_receipts group by 1"""

QUERY_SQL["adjacency"] = """
with e as (
  select topology_id, src_begin member, dst_begin other, src_begin, dst_begin, traffic from b_pairs
  union all
  select topology_id, dst_begin, src_begin, src_begin, dst_begin, traffic from b_pairs where src_begin <> dst_begin
), s as (
  select topology_id, slot_a member, slot_b other, slot_a, slot_b, traffic from b_slot_pairs
  union all
  select topology_id, slot_b, slot_a, slot_a, slot_b, traffic from b_slot_pairs
)
select 'executor' kind, topology_id, member, cast(other // 4096 as int) page, count(*) degree,
       cast(sum(traffic) as bigint) traffic,
       string_agg(src_begin || '>' || dst_begin || ':' || traffic, ' ' order by src_begin, dst_begin) edges
from e group by 2, 3, 4
union all
select 'slot', topology_id, member, cast(other // 4096 as int), count(*), cast(sum(traffic) as bigint),
       string_agg(slot_a || '-' || slot_b || ':' || traffic, ' ' order by slot_a, slot_b)
from s group by 2, 3, 4"""

QUERY_SQL["slot_occupancy"] = "select * from b_occupancy"
QUERY_SQL["node_occupancy"] = "select * from b_node_state"
QUERY_SQL["topology_slots_on_node"] = "select * from b_on_node"

QUERY_SQL["nodes_of_topology"] = """
select topology_id, cast(count(distinct node) as int) node_count, string_agg(distinct node, ', ' order by node) nodes
from b_slot_node group by 1"""

QUERY_SQL["slots_of_node"] = """
select node, cast(count(*) as int) slot_count,
       string_agg(topology_id || '/' || slot_id, ', ' order by topology_id, slot_id) slots
from b_slot_node group by 1"""

QUERY_SQL["host_cpu_totals"] = "select * from b_hosts"

VIEWS["b_last"] = """
select thread_id, cpu_total, cycles from (
  select *, row_number() over (partition by thread_id order by ts desc, event_id desc) rn from b_cycles
) q where rn = 1"""

QUERY_SQL["host_usage_pct"] = """
select h.host, cast(sum(l.cycles // 2) as bigint) used_hz, h.total_hz,
       cast(trunc(cast(sum(l.cycles // 2) as bigint)::double / h.total_hz::double * 100.0) as int) usage_pct
from b_last l join supplier on s_suppkey = l.thread_id % 10 join b_hosts h on h.host = s_name
group by h.host, h.total_hz"""

QUERY_SQL["assignment_map"] = """
select strftime(snapshot, '%Y-%m-%d') snapshot, host,
       string_agg(port || ' -> (' || executors || ')', ', ' order by port) slots
from b_slot_text group by 1, 2"""

QUERY_SQL["tuple_counts"] = """
select strftime(time_bucket(interval '6 hours', ts), '%Y-%m-%d %H:%M:%S') slot_start,
       topology_key, source_task, destination_task, count(*) tuples
from b_receipts group by 1, 2, 3, 4"""

# Series -------------------------------------------------------------------------------

QUERY_SQL["counter_delta"] = "select thread_id, event_id, cpu_total, cycles from b_cycles"

QUERY_SQL["moving_rate"] = """
with c as (
  select topology_key, source_task, time_bucket(interval '6 hours', ts) slot, count(*) * 21600 tuples
  from b_receipts group by 1, 2, 3
)
select topology_key series, cast(source_task as bigint) member, strftime(slot, '%Y-%m-%d %H:%M:%S') "at",
       cast(0 as bigint) event_id, cast(sum(tuples) over w // (count(*) over w * 3600) as bigint) rate
from c window w as (partition by topology_key, source_task order by slot rows between 5 preceding and current row)
union all
select 'load', thread_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), event_id,
       cast(sum(cycles) over v // (count(*) over v * 7) as bigint)
from b_cycles window v as (partition by thread_id order by ts, event_id rows between 5 preceding and current row)"""

QUERY_SQL["latest_sample"] = "select * from b_last"

VIEWS["b_ranked"] = """
select *, row_number() over (
  partition by topology_id order by traffic desc, src_begin, src_end, dst_begin, dst_end) "position"
from b_pairs"""

QUERY_SQL["rank_executor_traffic"] = "select * from b_ranked"

VIEWS["b_host_order"] = """
select name, free_ports, row_number() over (order by free_ports desc, name) host_rank,
       sum(free_ports) over (order by free_ports desc, name) so_far
from b_free"""

VIEWS["b_min_nodes"] = """
select *, cast(min_nodes + ceil(cast(0.5 as float) * cast(max_nodes - min_nodes as float)) as int) use_nodes
from (select cast(min(host_rank) as int) min_nodes,
             cast(least((select count(*) from b_free), 4) as int) max_nodes
      from b_host_order where so_far >= 4) q
where min_nodes is not null"""

QUERY_SQL["min_nodes_needed"] = "select * from b_min_nodes"

QUERY_SQL["round_robin_deal"] = """
select cast(slot as int) slot, name, port from (
  select row_number() over (order by round, host_rank) - 1 slot, name, port from (
    select p.name, p.port, h.host_rank, row_number() over (partition by p.name order by p.port) round
    from (select distinct name, port from b_ports where not used) p join b_host_order h using (name)
    where h.host_rank <= (select use_nodes from b_min_nodes)) q) r
where slot < 4"""

QUERY_SQL["assignment_changes"] = "select strftime(snapshot, '%Y-%m-%d') snapshot from b_changes"

# Ranking and picking -----------------------------------------------------------------

QUERY_SQL["top_executor_pairs"] = """
select topology_id, src_begin, src_end, dst_begin, dst_end, traffic, cast("position" as int) as "position"
from b_ranked where "position" <= 10"""

QUERY_SQL["slot_pairs_ranked"] = """
select *, row_number() over (order by traffic desc, topology_id, slot_a, slot_b) "position" from b_slot_pairs"""

QUERY_SQL["least_loaded_slot"] = """
with asked as (
  select topology_id, src_begin, dst_begin, 'source' form, 1 k, src_load x from b_placed
  union all select topology_id, src_begin, dst_begin, 'both', 2, src_load + dst_load from b_placed
  union all select topology_id, src_begin, dst_begin, 'heavier', 1, greatest(src_load, dst_load) from b_placed
), ranked as (
  select a.*, s.slot_id, row_number() over (
    partition by a.topology_id, src_begin, dst_begin, form order by s.load nulls last, s.slot_id) rn
  from asked a left join b_state s on s.topology_id = a.topology_id
    and s.max_executors - s.executors >= a.k and s.load + a.x <= s.max_load
)
select topology_id, src_begin, dst_begin, form, coalesce(slot_id, -1) slot_id from ranked where rn = 1"""

VIEWS["b_node_asked"] = """
with p as (
  select p.*, a.load load_a, b.load load_b from b_slot_pairs p
  join b_occupancy a on a.topology_id = p.topology_id and a.slot_id = p.slot_a
  join b_occupancy b on b.topology_id = p.topology_id and b.slot_id = p.slot_b
)
select topology_id, 'one' form, slot_id slot_a, slot_id slot_b, 1 k, load x from b_occupancy
union all select topology_id, 'unused', slot_id, slot_id, 1, load from b_occupancy
union all select topology_id, 'both', slot_a, slot_b, 2, load_a + load_b from p
union all select topology_id, 'heavier', slot_a, slot_b, 1, greatest(load_a, load_b) from p"""

VIEWS["b_node_picked"] = """
select topology_id, form, slot_a, slot_b, name as node from (
  select a.*, n.name, row_number() over (
    partition by a.topology_id, form, slot_a, slot_b order by n.load nulls last, n.name) rn
  from b_node_asked a join b_limits l using (topology_id)
  left join (select n.*, t.topology_id, coalesce(o.slots, 0) here
             from b_node_state n cross join b_topology t
             left join b_on_node o on o.node = n.name and o.topology_id = t.topology_id) n
    on n.topology_id = a.topology_id and n.free_ports >= a.k and n.load + a.x <= n.capacity
   and n.here + a.k <= l.max_slots and (a.form <> 'unused' or n.here = 0)
) q where rn = 1"""

QUERY_SQL["least_loaded_node"] = """
select topology_id, form, slot_a, slot_b, coalesce(node, 'none') node from b_node_picked"""

QUERY_SQL["hosts_by_free_ports"] = """
select name, free_ports, host_rank as "position" from b_host_order"""

# Sets -----------------------------------------------------------------------------------

QUERY_SQL["stale_topologies"] = """
select topology_id, topology_key from b_topology where topology_key not in (select topology_key from b_live)"""

QUERY_SQL["active_topologies"] = """
select topology_id, topology_key from b_topology where topology_key in (select topology_key from b_live)"""

QUERY_SQL["union_ports"] = "select distinct name, port from b_ports"

QUERY_SQL["unused_nodes"] = """
select t.topology_id, n.name as node from b_topology t cross join b_node n
where not exists (select 1 from b_slot_node s where s.topology_id = t.topology_id and s.node = n.name)"""

# Scalar functions -------------------------------------------------------------------------

QUERY_SQL["max_executors_per_slot"] = "select topology_id, slot_count, max_executors from b_limits"
QUERY_SQL["nodes_to_use"] = "select topology_id, nodes_to_use from b_limits"
QUERY_SQL["max_slots_per_node"] = "select topology_id, max_slots from b_limits"
QUERY_SQL["max_load_per_slot"] = "select topology_id, max_load from b_limits"

QUERY_SQL["param_limits"] = """
with a as (
  select *, conf_id % 37 + 1 ex, least(conf_id % 11 + 1, conf_id % 37 + 1) sc, conf_id % 9 + 1 nodes from b_conf
), c as (
  select *, least(nodes, sc) n, ceil(cast(ex as double) / sc) e_lo,
         ceil(cast(sc as double) / least(nodes, sc)) n_lo from a
), d as (
  select *, n_lo + ceil(beta * cast(n - n_lo as float)) use_n from c
)
select conf_id, cast(e_lo + ceil(alfa * cast(ex - sc + 1 - e_lo as float)) as int) max_executors,
       cast(use_n as int) nodes_to_use,
       cast(ceil(sc / use_n) + ceil(cast(delta as double) * (sc - use_n + 1 - ceil(sc / use_n))) as int) max_slots,
       coalesce(cast(trunc(gamma * cast(conf_id * 1000003 // sc as float)) as bigint), -1) max_load
from d"""

QUERY_SQL["absolute_capacity"] = "select host, total_hz // 100 * 80 capacity from b_hosts"

QUERY_SQL["mhz_to_hz"] = """
select p_partkey, cast(trunc(cast(round(p_retailprice, 2) as float)) as bigint) * 1048576 hz from part"""

QUERY_SQL["traffic_threshold"] = """
select event_id, cast(trunc(cast(current_traffic as float)
  * (cast(1 as float) - cast((event_id % 100 + 1) / 100.0 as float))) as bigint) threshold
from b_eval"""

QUERY_SQL["list_to_csv"] = """
with a as (
  select s_suppkey, case when s_suppkey % 5 = 0 then 'null' when s_suppkey % 4 = 0 then '<empty list>'
    when s_suppkey % 4 = 1 then s_suppkey::varchar
    when s_suppkey % 4 = 2 then s_suppkey || ', ' || (s_suppkey + 1)
    else s_suppkey || ', ' || (s_suppkey + 1) || ', ' || (s_suppkey + 2) end items
  from supplier)
select s_suppkey, items, case when s_suppkey % 7 = 0 then '<empty map>' when s_suppkey % 7 = 1 then 'null'
  else 'a -> (' || s_suppkey || '), b -> (' || items || ')' end mapped
from a"""

QUERY_SQL["serialize_assignment"] = """
select strftime(snapshot, '%Y-%m-%d') snapshot, assignment from b_snapshot_text"""

QUERY_SQL["format_ts"] = """select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') "at" from events"""

QUERY_SQL["split_key_value"] = """
select host, cast(processor * 4 + line_no as int) line_no, key, value from (
  select host, processor, 0 line_no, 'processor' as key, processor::varchar as value from b_cores
  union all select host, processor, 1, 'model name', model_name from b_cores
  union all select s_name, 0, 2, 'cpu MHz', (1000 + s_suppkey) || '.937' from supplier
  union all select s_name, 1, 2, 'cpu MHz', (2000 + s_suppkey) || '.5' from supplier) q"""

QUERY_SQL["edge_labels"] = """
select 'task' kind, topology_id, '[' || source_task || '->' || destination_task || ']' as label from b_traffic
union all
select 'executor', topology_id, '{[' || src_begin || ', ' || src_end || '] -> [' || dst_begin || ', ' || dst_end
  || ']: ' || traffic || ' tuple/s}' from b_pairs
union all
select 'slot', topology_id, '{' || slot_a || '; ' || slot_b || '; traffic: ' || traffic || ' tuple/s}'
from b_slot_pairs"""

# What if ------------------------------------------------------------------------------------

QUERY_SQL["affinity"] = "select * from b_affinity"
QUERY_SQL["slot_affinity"] = "select * from b_slot_affinity"

QUERY_SQL["score_moves"] = """
with home as (
  select x.topology_id, x.begin_task, x.end_task, x.slot_id from_slot, coalesce(a.affinity, 0) h
  from b_exec_slot x left join b_affinity a using (topology_id, begin_task, end_task, slot_id)
)
select h.topology_id, h.begin_task, h.end_task, h.from_slot, a.slot_id to_slot, h.h - a.affinity delta
from home h join b_affinity a using (topology_id, begin_task, end_task) where a.slot_id <> h.from_slot
union all
select topology_id, begin_task, end_task, from_slot, -1, h from home
where (select count(*) from b_state s where s.topology_id = home.topology_id) > 1 + (
  select count(*) from b_affinity a where a.topology_id = home.topology_id and a.begin_task = home.begin_task
    and a.end_task = home.end_task and a.slot_id <> home.from_slot)"""

# Recomputes the whole cut for every move: slow, so only used where few moves exist.
QUERY_SQL["best_move_to_empty"] = """
with movers as (
  select x.* from b_exec_slot x join b_state s using (topology_id, slot_id)
  where s.executors > 1 and x.load <= s.max_load
), cost as (
  select m.topology_id, m.begin_task, m.end_task, m.slot_id from_slot, coalesce(sum(p.traffic), 0) home
  from movers m left join b_placed p on p.topology_id = m.topology_id and p.src_slot = p.dst_slot
    and p.src_begin <> p.dst_begin and (p.src_begin = m.begin_task or p.dst_begin = m.begin_task)
  group by 1, 2, 3, 4
), best as (
  select *, row_number() over (partition by topology_id order by home, begin_task, end_task) rn from cost
)
select e.topology_id, e.slot_id to_slot, b.from_slot, b.begin_task, b.end_task,
       cast(coalesce(c.traffic, 0) + b.home as bigint) cut
from b_state e join best b on b.topology_id = e.topology_id and b.rn = 1
left join b_cut c on c.topology_id = e.topology_id where e.executors = 0"""

VIEWS["b_part_slot"] = """
select topology_id, begin_task, end_task, load, case when begin_task // 4 % 3 = 1 then null else slot_id end slot_id
from b_exec_slot"""

VIEWS["b_part_state"] = """
select s.topology_id, s.slot_id, cast(count(p.load) as int) executors, cast(coalesce(sum(p.load), 0) as bigint) load,
       s.max_executors, s.max_load
from b_state s left join b_part_slot p on p.topology_id = s.topology_id and p.slot_id = s.slot_id
group by all"""

# Both directions of every pair with where the ends stand.
VIEWS["b_part_links"] = """
with link as (
  select topology_id, src_begin e, dst_begin f, traffic from b_pairs where src_begin <> dst_begin
  union all select topology_id, dst_begin, src_begin, traffic from b_pairs where src_begin <> dst_begin
)
select l.topology_id, e, f, cast(sum(traffic) as bigint) w, max(a.slot_id) slot_e, max(b.slot_id) slot_f
from link l join b_part_slot a on a.topology_id = l.topology_id and a.begin_task = e
join b_part_slot b on b.topology_id = l.topology_id and b.begin_task = f
group by 1, 2, 3"""

# What a placement changes is summed over the links of the two units, one by one.
VIEWS["b_scored_pairs"] = """
with p as (
  select l.topology_id, e first_begin, f second_begin, w, a.end_task first_end, b.end_task second_end,
         slot_e s1, slot_f s2, a.load l1, b.load l2
  from b_part_links l join b_part_slot a on a.topology_id = l.topology_id and a.begin_task = e
  join b_part_slot b on b.topology_id = l.topology_id and b.begin_task = f
  where e < f
), free as (
  select *, max_executors - executors places from b_part_state
), pick as (
  select p.*, s.slot_id, row_number() over (partition by p.topology_id, first_begin, second_begin order by s.load, s.slot_id) rn
  from p join free s on s.topology_id = p.topology_id and not (s1 is null and s2 is null)
   and places >= 1 and s.load + greatest(l1, l2) <= s.max_load
), joint as (
  select p.topology_id, first_begin, second_begin, s.slot_id,
    row_number() over (partition by p.topology_id, first_begin, second_begin order by s.load, s.slot_id) rn
  from p join free s on s.topology_id = p.topology_id and s1 is null and s2 is null
   and places >= 2 and s.load + l1 + l2 <= s.max_load
), own as (
  select p.*, s.slot_id, row_number() over (partition by p.topology_id, first_begin, second_begin order by s.load, s.slot_id) rn
  from p join free s on s.topology_id = p.topology_id and s1 is null and s2 is null and places >= 1
  where (p.topology_id, first_begin, second_begin) not in (select topology_id, first_begin, second_begin from joint)
), combo as (
  select p.*, a.slot_id n1, b.slot_id n2 from p
  join (select topology_id, first_begin, second_begin, s1 slot_id from p where (topology_id, s1) in (select topology_id, slot_id from free)
        union select topology_id, first_begin, second_begin, s2 from p where (topology_id, s2) in (select topology_id, slot_id from free)
        union select topology_id, first_begin, second_begin, slot_id from pick where rn = 1) a
    using (topology_id, first_begin, second_begin)
  join (select topology_id, first_begin, second_begin, s1 slot_id from p where (topology_id, s1) in (select topology_id, slot_id from free)
        union select topology_id, first_begin, second_begin, s2 from p where (topology_id, s2) in (select topology_id, slot_id from free)
        union select topology_id, first_begin, second_begin, slot_id from pick where rn = 1) b
    using (topology_id, first_begin, second_begin)
  union all
  select p.*, j.slot_id, j.slot_id from p join joint j using (topology_id, first_begin, second_begin) where j.rn = 1
  union all
  select p.*, o.slot_id, q.slot_id from p
  join own o on o.topology_id = p.topology_id and o.first_begin = p.first_begin and o.second_begin = p.second_begin
   and o.rn = 1
  join own q on q.topology_id = p.topology_id and q.first_begin = p.first_begin and q.second_begin = p.second_begin
   and q.rn = 2
), links as (
  select topology_id, e unit, slot_f, slot_e, sum(w) w from b_part_links where slot_f is not null group by all
), cost as (
  -- links to placed others: what is cut now, and what would be
  select c.topology_id, c.first_begin, c.second_begin, n1, n2,
    sum(case when slot_f <> n1 and unit = c.first_begin or slot_f <> n2 and unit = c.second_begin then l.w else 0 end)
      - sum(case when slot_e is not null and slot_f <> slot_e then l.w else 0 end) change
  from combo c left join links l on l.topology_id = c.topology_id and (l.unit = c.first_begin or l.unit = c.second_begin)
  group by 1, 2, 3, 4, 5
), total as (
  select topology_id, sum(w) // 2 now from b_part_links where slot_e <> slot_f group by 1
), fixed as (
  -- the pair's own link was counted against where its ends stand now: once for each placed partner
  select c.*, coalesce(now, 0) + change
    - case when s2 is not null and s2 <> n1 then c.w else 0 end - case when s1 is not null and s1 <> n2 then c.w else 0 end
    + case when s1 is not null and s2 is not null and s1 <> s2 then c.w else 0 end
    + case when n1 <> n2 then c.w else 0 end cut
  from combo c join cost using (topology_id, first_begin, second_begin, n1, n2)
  left join total t on t.topology_id = c.topology_id
), moved as (
  select f.*, slot_id,
    r.executors - coalesce((slot_id = s1)::int, 0) - coalesce((slot_id = s2)::int, 0)
      + (slot_id = n1)::int + (slot_id = n2)::int held, r.max_executors,
    r.load - case when slot_id = s1 then l1 else 0 end - case when slot_id = s2 then l2 else 0 end
      + case when slot_id = n1 then l1 else 0 end + case when slot_id = n2 then l2 else 0 end carried, r.max_load
  from fixed f join b_part_state r on r.topology_id = f.topology_id and r.slot_id in (n1, n2)
), judged as (
  select topology_id, first_begin, second_begin, n1, n2, any_value(cut) cut,
    bool_and(held <= max_executors and carried <= max_load) feasible
  from moved group by 1, 2, 3, 4, 5
)
select p.topology_id, p.first_begin, p.first_end, p.second_begin, p.second_end, n1 first_slot, n2 second_slot,
       cast(cut as bigint) cut, coalesce(feasible, false) feasible
from p left join judged using (topology_id, first_begin, second_begin)"""

QUERY_SQL["score_pair_placements"] = "select * from b_scored_pairs"

QUERY_SQL["best_pair_placement"] = """
select topology_id, first_begin, first_end, second_begin, second_end,
       case when feasible then cut end cut, case when feasible then first_slot end first_slot,
       case when feasible then second_slot end second_slot
from (
  select *, row_number() over (partition by topology_id, first_begin, second_begin
                               order by feasible desc, cut, first_slot, second_slot) rn
  from b_scored_pairs) q
where rn = 1"""

QUERY_SQL["score_slot_moves"] = """
select s.topology_id, s.slot_id, s.node from_node, p.node to_node,
       coalesce(h.affinity, 0) - coalesce(t.affinity, 0) delta
from b_slot_node s
join b_on_node o on o.topology_id = s.topology_id and o.node = s.node and o.slots > 1
join b_node_picked p on p.topology_id = s.topology_id and p.slot_a = s.slot_id and p.form = 'unused'
left join b_slot_affinity h on h.topology_id = s.topology_id and h.slot_id = s.slot_id and h.node = s.node
left join b_slot_affinity t on t.topology_id = s.topology_id and t.slot_id = s.slot_id and t.node = p.node
where p.node is not null"""

VIEWS["b_part_node"] = """
select * from b_slot_node where (slot_id + topology_id) % 3 <> 1"""

VIEWS["b_part_room"] = """
select n.name, t.topology_id, n.capacity, l.max_slots, coalesce(n.ports, 0) - coalesce(u.slots, 0) free_ports,
       coalesce(u.load, 0) load, coalesce(o.slots, 0) here
from b_node_state n cross join b_topology t join b_limits l using (topology_id)
left join (select node, count(*) slots, cast(sum(load) as bigint) load
           from b_part_node join b_occupancy using (topology_id, slot_id) group by 1) u on u.node = n.name
left join (select node, topology_id, count(*) slots from b_part_node group by 1, 2) o
  on o.node = n.name and o.topology_id = t.topology_id"""

QUERY_SQL["score_slot_pair_placements"] = """
with x as (
  select q.topology_id, q.slot_a, q.slot_b, q.traffic, a.node node_of_a, b.node node_of_b
  from b_slot_pairs q left join b_part_node a on a.topology_id = q.topology_id and a.slot_id = q.slot_a
  left join b_part_node b on b.topology_id = q.topology_id and b.slot_id = q.slot_b
), p as (
  select x.*, a.load l1, b.load l2 from x
  join b_occupancy a on a.topology_id = x.topology_id and a.slot_id = x.slot_a
  join b_occupancy b on b.topology_id = x.topology_id and b.slot_id = x.slot_b
), pick as (
  select p.*, r.name, row_number() over (partition by p.topology_id, slot_a, slot_b order by r.load, r.name) rn
  from p join b_part_room r on r.topology_id = p.topology_id and coalesce(node_of_a, node_of_b) is not null
   and r.free_ports >= 1 and r.here + 1 <= r.max_slots and r.load + greatest(l1, l2) <= r.capacity
), joint as (
  select p.*, r.name, row_number() over (partition by p.topology_id, slot_a, slot_b order by r.load, r.name) rn
  from p join b_part_room r on r.topology_id = p.topology_id and coalesce(node_of_a, node_of_b) is null
   and r.free_ports >= 2 and r.here + 2 <= r.max_slots and r.load + l1 + l2 <= r.capacity
), first as (
  select p.*, r.name, row_number() over (partition by p.topology_id, slot_a, slot_b order by r.load, r.name) rn
  from p join b_part_room r on r.topology_id = p.topology_id and coalesce(node_of_a, node_of_b) is null
   and r.free_ports >= 1 and r.here + 1 <= r.max_slots and r.load + l1 <= r.capacity
  where (p.topology_id, slot_a, slot_b) not in (select topology_id, slot_a, slot_b from joint)
), second as (
  select f.*, r.name other, row_number() over (partition by f.topology_id, slot_a, slot_b order by r.load, r.name) rk
  from first f join b_part_room r on f.rn = 1 and r.topology_id = f.topology_id and r.name <> f.name
   and r.free_ports >= 1 and r.here + 1 <= r.max_slots and r.load + l2 <= r.capacity
), cand as (
  select topology_id, slot_a, slot_b, node_of_a node from p where node_of_a is not null
  union select topology_id, slot_a, slot_b, node_of_b from p where node_of_b is not null
  union select topology_id, slot_a, slot_b, name from pick where rn = 1
), combo as (
  select p.*, a.node n1, b.node n2 from p join cand a using (topology_id, slot_a, slot_b)
  join cand b using (topology_id, slot_a, slot_b)
  union all select * exclude (name, rn), name, name from joint where rn = 1
  union all select * exclude (name, rn, other, rk), name, other from second where rk = 1
), placed as (
  -- where every slot of the topology would sit under each combination
  select c.topology_id, c.slot_a, c.slot_b, n1, n2, x.traffic,
         case when x.slot_a = c.slot_a then n1 when x.slot_a = c.slot_b then n2 else x.node_of_a end np,
         case when x.slot_b = c.slot_a then n1 when x.slot_b = c.slot_b then n2 else x.node_of_b end nq,
         x.node_of_a op, x.node_of_b oq
  from combo c join x on x.topology_id = c.topology_id
), change as (
  select topology_id, slot_a, slot_b, n1, n2,
         cast(sum(case when np <> nq then traffic else 0 end) - sum(case when op <> oq then traffic else 0 end)
              as bigint) delta
  from placed group by 1, 2, 3, 4, 5
), moved as (
  select c.*, r.name,
    least(r.free_ports, r.max_slots - r.here) + coalesce((name = node_of_a)::int, 0) + coalesce((name = node_of_b)::int, 0)
      - (name = n1)::int - (name = n2)::int room,
    r.load - case when name = node_of_a then l1 else 0 end - case when name = node_of_b then l2 else 0 end
      + case when name = n1 then l1 else 0 end + case when name = n2 then l2 else 0 end carried, r.capacity
  from combo c join b_part_room r on r.topology_id = c.topology_id and r.name in (n1, n2)
), judged as (
  select topology_id, slot_a, slot_b, n1, n2, bool_and(room >= 0 and carried <= capacity) feasible
  from moved group by 1, 2, 3, 4, 5
)
select p.topology_id, p.slot_a, p.slot_b, n1 node_a, n2 node_b, delta, coalesce(feasible, false) feasible
from p left join (judged join change using (topology_id, slot_a, slot_b, n1, n2)) using (topology_id, slot_a, slot_b)"""

QUERY_SQL["node_spread_gap"] = """
select topology_id, cast(u.n as int) node_count, nodes_to_use, cast(nodes_to_use - u.n as int) gap
from (select topology_id, count(distinct node) n from b_slot_node group by 1) u join b_limits using (topology_id)
where nodes_to_use > u.n"""

QUERY_SQL["compare_placements"] = """
with cur as (select node, cast(sum(load) as bigint) v from b_load group by 1),
pro as (select node, cast(sum(load) as bigint) v from b_proposed group by 1)
select 'inter_node_traffic' metric, '' node,
       (select cast(coalesce(sum(traffic), 0) as bigint) from b_edge where src_node <> dst_node) current_value,
       (select cast(coalesce(sum(traffic), 0) as bigint) from b_cross_proposed) proposed_value
union all
select 'overloaded_nodes', '', (select count(*) from b_over), (select count(*) from b_over_proposed)
union all
select 'node_load', n.name, coalesce(c.v, 0), coalesce(p.v, 0)
from b_node n left join cur c on c.node = n.name left join pro p on p.node = n.name
where c.v is not null or p.v is not null"""

QUERY_SQL["relieved_nodes"] = "select * from b_relieved"

QUERY_SQL["reschedule_decision"] = """
with v as (
  select (select cast(coalesce(sum(traffic), 0) as bigint) from b_edge where src_node <> dst_node) current_traffic,
         (select cast(coalesce(sum(traffic), 0) as bigint) from b_cross_proposed) best_traffic,
         30 improvement, coalesce((select bool_or(relieved) from b_relieved), false) due_to_overload
), w as (
  select *, cast(trunc(cast(current_traffic as float) * (cast(1 as float) - cast(0.3 as float))) as bigint) threshold
  from v
)
select current_traffic, best_traffic, improvement, threshold, threshold >= best_traffic as due_to_traffic,
       due_to_overload, threshold >= best_traffic or due_to_overload as wanted
from w"""

# The first wanted evaluation fires, then always the first one 12 hours later or more.
VIEWS["b_wanted"] = """
select topology_key, eval_ts, min(event_id) event_id from b_eval
where relieves_overload or cast(trunc(cast(current_traffic as float) * (cast(1 as float) - cast(0.3 as float)))
                                as bigint) >= best_traffic
group by 1, 2"""

VIEWS["b_fires"] = """
with recursive fire as (
  select topology_key, min(eval_ts) eval_ts from b_wanted group by 1
  union all
  select topology_key, (select min(w.eval_ts) from b_wanted w
                        where w.topology_key = f.topology_key and w.eval_ts >= f.eval_ts + interval '12 hours')
  from fire f where f.eval_ts is not null
)
select topology_key, eval_ts, event_id from fire join b_wanted using (topology_key, eval_ts)"""

QUERY_SQL["cooldown_alerts"] = """
select topology_key, event_id, strftime(eval_ts, '%Y-%m-%d %H:%M:%S') eval_ts from b_fires"""

# Reports -------------------------------------------------------------------------------------

QUERY_SQL["monitoring_cycle"] = """
with t as (
  select topology_id, topology_key from b_topology
  union all
  select cast((select max(topology_id) from b_topology) + row_number() over (order by md5(k)) as int), k
  from (select distinct event_type k from events where event_type not in (select topology_key from b_topology)) q
), c as (
  select topology_key, source_task, destination_task % 5 d, cast(ts as date) slot, count(*) n
  from b_receipts group by 1, 2, 3, 4
), r as (
  select *, sum(n) over w // count(*) over w rate,
         row_number() over (partition by topology_key, source_task, d order by slot desc) rn
  from c window w as (partition by topology_key, source_task, d order by slot rows between 5 preceding and current row)
)
select topology_id, source_task, d destination_task, cast(rate as int) traffic
from r join t using (topology_key) where rn = 1"""

QUERY_SQL["load_cycle"] = """
with r as (
  select thread_id, cast(sum(cycles) over v // (count(*) over v * 7) as bigint) load,
         row_number() over (partition by thread_id order by ts desc, event_id desc) rn
  from b_cycles window v as (partition by thread_id order by ts, event_id rows between 5 preceding and current row)
), e as (
  select cast(source_task as bigint) thread_id, min(destination_task) begin_task, max(destination_task) end_task
  from b_receipts group by 1
)
select thread_id, begin_task, end_task, load from r join e using (thread_id) where rn = 1"""

QUERY_SQL["evaluation_summary"] = """
select t.topology_id, t.topology_key, l.total_load, p.n is not null as complete, coalesce(p.n, 0) pairs,
       coalesce(c.traffic, 0) cut, cast(coalesce(u.n, 0) as int) node_count,
       cast(greatest(m.nodes_to_use - u.n, 0) as int) gap
from b_topology t join b_live using (topology_key)
left join (select topology_id, cast(sum(load) as bigint) total_load from b_load group by 1) l using (topology_id)
left join (select topology_id, count(*) n from b_pairs group by 1) p using (topology_id)
left join b_cut c using (topology_id)
left join (select topology_id, count(distinct node) n from b_slot_node group by 1) u using (topology_id)
left join b_limits m using (topology_id)"""

QUERY_SQL["tracked_assignment"] = """
select topology_key, host, string_agg(txt, '' order by port) assignment from (
  select t.topology_key, n.node host, x.slot_id port,
         '(' || n.node || ':' || x.slot_id || ' ' || string_agg(
           x.component || '[' || x.begin_task || ',' || x.end_task || ']', ', '
           order by x.component || '[' || x.begin_task || ',' || x.end_task || ']') || ')' txt
  from b_exec_slot x join b_slot_node n using (topology_id, slot_id) join b_topology t using (topology_id)
  group by 1, 2, 3) q
group by 1, 2"""

# Streams: what is closed when the watermark stands one hour before the last event.

VIEWS["b_slot_counts"] = """
select time_bucket(interval '6 hours', ts) slot, topology_key, source_task, destination_task, count(*) tuples
from b_receipts group by 1, 2, 3, 4"""

VIEWS["b_slot_rates"] = """
select topology_key, source_task, destination_task, slot,
       cast(sum(tuples * 21600) over w // (count(*) over w * 5000) as bigint) rate
from b_slot_counts window w as (
  partition by topology_key, source_task, destination_task order by slot rows between 5 preceding and current row)"""

QUERY_SQL["stream_receipts"] = """
select topology_key, strftime(ts, '%Y-%m-%d %H:%M:%S') ts, event_id, source_task, destination_task from b_receipts"""

QUERY_SQL["stream_tuple_counts"] = """
select strftime(slot, '%Y-%m-%d %H:%M:%S') slot_start, topology_key, source_task, destination_task, tuples
from b_slot_counts"""

QUERY_SQL["stream_moving_rate"] = """
select topology_key, source_task, destination_task, strftime(slot, '%Y-%m-%d %H:%M:%S') slot_start, rate
from b_slot_rates"""

QUERY_SQL["stream_counter_delta"] = QUERY_SQL["counter_delta"]

QUERY_SQL["stream_upsert_stats"] = """
select topology_key, source_task, destination_task, rate from (
  select *, row_number() over (partition by topology_key, source_task, destination_task order by slot desc) rn
  from b_slot_rates) q
where rn = 1"""

QUERY_SQL["stream_cooldown_alerts"] = QUERY_SQL["cooldown_alerts"]

QUERY_SQL["stream_assignment_changes"] = """
select strftime(snapshot, '%Y-%m-%d') snapshot from (
  select snapshot, assignment, lag(assignment) over (order by snapshot) before, lag(snapshot) over (order by snapshot) earlier
  from b_snapshot_text) q
where before is null or before <> assignment or snapshot - earlier > 1"""


def _closure(sql: str) -> list[str]:
    """Views a text needs, in definition order."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        for name in set(re.findall(r"\bb_\w+", todo.pop())) & VIEWS.keys() - needed:
            needed.add(name)
            todo.append(VIEWS[name])
    order, done = [], set()

    def visit(name: str) -> None:
        if name in done:
            return
        done.add(name)
        for other in sorted(set(re.findall(r"\bb_\w+", VIEWS[name])) & VIEWS.keys() - {name}):
            visit(other)
        order.append(name)

    for name in sorted(needed):
        visit(name)
    return order


def _complete(sql: str) -> str:
    """One statement: the views as materialized tables, then the query."""
    views = ",\n".join(f"{v} as materialized ({VIEWS[v]})" for v in _closure(sql))
    return f"with {views}\nselect * from ({sql}) q" if views else sql.strip()


ORACLE = {name: _complete(sql) for name, sql in QUERY_SQL.items()}
