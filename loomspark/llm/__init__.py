"""Training-data operators: quality rules, URL lists, near-duplicates, chat logs, toxicity,
decontamination, substring dedup, language-model quality, token files and BPE.

Nothing outside this folder imports it; ``queries.py`` registers its queries.
"""
