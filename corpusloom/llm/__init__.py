"""Training-data operators: language identification, tokenisation, language-model
scoring, source mixing, license scans, toxicity, quality rules, line and document
deduplication and document fingerprints.  Nothing outside this folder imports it."""
