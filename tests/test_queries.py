"""Every query against its oracle, and the contract of the driver."""

import pytest
from oracle import connect, differences

from ferrylake.plans import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_oracle(spark, small, name):
    df = registry.queries()[name](spark, small)
    assert differences(df, registry.oracle_sql()[name], connect(small)) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_every_surveyed_query_is_there():
    wanted = """pending_anti incremental_scan root_unfinished keyset_by_id retry_queue offset_page count_skipped count_by_type latest_time latest_id
    exists_flags key_lookup partition_inherit route_action skip_reason_first find_one_ambiguous anti_missing_node fixpoint_retry first_per_key latest_per_key
    variable_group distinct_partitions root_group parent_lookup latest_version first_match references_collect severity_groups most_severe total_findings
    none_start_event auth_expand perm_all owner_exists membership_after_parent api_coverage api_sections endpoint_filter endpoint_sort enrich_sentinel
    key_encode legacy_prefix prefix_validate tenant_default strip_suffix stringify_null csv_guard kebab regex_extract short_name auto_cancel suffix_dispatch
    headings_toc coverage_missing active_leaves expr_rewrite worker_name version_gate finished_states template_fill prefix_delete xml_nodes udf_chain job_drain""".split()
    assert not set(wanted) - set(registry.queries())
