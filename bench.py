"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the
input and the local cores.  Query names as arguments replace the headline list.
"""

from __future__ import annotations

import json
import os
import sys
import time

from cutline import suite
from cutline.plans.stage import drop_staged
from cutline.session import session

HEADLINE = """
    a1_riff_chunks a2_chunk_crc_audit a3_png_summary a4_front_matter a5_project_cuts
    b1_clip_intervals b2_merge_intervals b3_keep_ranges b5_to_output_time b5_kept_samples
    b6_from_output_time b7_drop_cut_samples b8_trim_window b9_snap_to_kept
    b10_intervals_from_marks b11_segment_timeline
    c1_uniform_grid c2_even_grid c3_asof_sample c4_thin_min_gap c5_take_every c10_restamp
    d2_curve_lut d4_colormap d6_filter_chain d7_histogram256 d12_composite_over
    e3_resample e4_fit_boxes e5_trim_bbox
    f1_change_bbox f2_best_predecessor f3_delta_encode f4_palette_stats f5_pca_split_codebook
    f6_assign_nearest f7_replay_kept f8_moment_stats
    g1_frame_budget g3_expand_variants g4_first_supported g5_size_report g6_evict_cold
    h2_field_values h3_form_fill_stats h4_changed_fields h6_write_report h7_copy_to_all_pages
    h9_to_page_space h12_nearest
    i1_fuzzy_search i2_unencodable_chars i3_sanitize_text i4_post_index i5_apply_defaults
    j1_debounce j2_coalesce_edits j3_throttle j4_latest_pending j6_kept_samples j7_keep_last_n
""".split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "cutline-bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = suite.queries()
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    # Warm the JVM, the Python workers and the file cache once.
    for name in ("b5_kept_samples", "c4_thin_min_gap"):
        run(name)
    times = {name: run(name) for name in names}
    total = round(sum(times.values()), 3)
    drop_staged(spark)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": total, "unit": "sec",
        "queries": times, "sf": os.path.basename(os.path.normpath(sf)).removeprefix("sf"),
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
