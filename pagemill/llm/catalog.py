"""Queries of the training-data operators."""

from pagemill.llm import encoding, language, leakage, main_content, markup, packing, residue, site_lines
from pagemill.session import load


def p1_found(spark, d):
    return encoding.garbled_pages(load(spark, d, "http_cache"), load(spark, d, "documents")).select("page_id").distinct()


def p1_repaired(spark, d):
    return encoding.repaired_pages(load(spark, d, "http_cache"), load(spark, d, "documents"))


def p1_declared(spark, d):
    return encoding.declared_charsets(load(spark, d, "http_cache"), load(spark, d, "documents"), load(spark, d, "crawl_pages"))


def p2_clean_titles(spark, d):
    return markup.clean_titles(load(spark, d, "crawl_pages")).distinct()


def p2_found(spark, d):
    return markup.found(load(spark, d, "http_cache"), load(spark, d, "crawl_pages"))


def p2_clean(spark, d):
    return markup.clean_pages(load(spark, d, "http_cache"), load(spark, d, "crawl_pages"))


def p3_found(spark, d):
    return main_content.chrome_blocks(load(spark, d, "http_cache")).select("page_id", "block_crc").distinct()


def p3_main_text(spark, d):
    return main_content.main_text(load(spark, d, "http_cache"))


def p3_selection_check(spark, d):
    return main_content.selection_check(load(spark, d, "http_cache"), load(spark, d, "crawl_pages"))


def p4_found(spark, d):
    return residue.residue_pages(load(spark, d, "http_cache"), load(spark, d, "documents")).distinct()


def p4_kept_pages(spark, d):
    return residue.without_residue(load(spark, d, "http_cache"), load(spark, d, "documents")).select("page_id", "byte_length")


def p5_found(spark, d):
    return site_lines.found(load(spark, d, "http_cache"), load(spark, d, "crawl_pages"))


def p5_clean(spark, d):
    return site_lines.without_repeated(load(spark, d, "http_cache"), load(spark, d, "crawl_pages"))


def p5_templates(spark, d):
    return site_lines.templates(load(spark, d, "http_cache"), load(spark, d, "crawl_pages"))


def p8_containers(spark, d):
    return packing.containers(load(spark, d, "documents"))


def p8_fill(spark, d):
    return packing.fill_report(packing.containers(load(spark, d, "documents")))


def p8_fill_single_bucket(spark, d):
    return packing.fill_report(packing.containers(load(spark, d, "documents"), across=False))


def p9_found(spark, d):
    return leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p9_evidence(spark, d):
    return leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p10_found(spark, d):
    return language.mislabelled(load(spark, d, "documents")).select("doc_id", "lang").distinct()


def p10_languages(spark, d):
    return language.document_languages(load(spark, d, "documents"))


def p10_segments(spark, d):
    return language.segments(load(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_repaired, p1_declared, p2_found, p2_clean, p2_clean_titles, p3_found, p3_main_text, p3_selection_check, p4_found, p4_kept_pages, p5_found, p5_clean, p5_templates,
        p8_containers, p8_fill, p8_fill_single_bucket, p9_found, p9_evidence, p10_found, p10_languages, p10_segments,
    )
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return {}
