"""Corpus distillation on Spark: cluster, weigh, sample and write training sets."""
