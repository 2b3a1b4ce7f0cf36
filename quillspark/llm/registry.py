"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from quillspark.llm import fingerprints, language, linefilter, maintext, manifest, media, mixing, neardup, packing, personal, quality, repeats, warc

QUERIES = {
    "op1_consistent_weighted_fingerprints": fingerprints.op1_consistent_weighted_fingerprints,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_ordinal_quality": quality.op3_ordinal_quality,
    "op4_signature_tree_join": neardup.op4_signature_tree_join,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_candidate_boosting": personal.op6_candidate_boosting,
    "op7_ogg_media": media.op7_ogg_media,
    "op8_warc_revisits": warc.op8_warc_revisits,
    "op9_text_density_extraction": maintext.op9_text_density_extraction,
    "op10_hyperdimensional_language": language.op10_hyperdimensional_language,
    "op11_periodic_runs": repeats.op11_periodic_runs,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_cuckoo_lines": linefilter.op13_cuckoo_lines,
}
ORACLES = {"op2_source_mix": mixing.OP2_SQL, "op12_merkle_manifest": manifest.OP12_SQL, "op13_cuckoo_lines": linefilter.OP13_SQL}
