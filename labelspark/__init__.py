"""Annotated-text analytics on Spark.

Consensus labels from annotator votes, text cleaning, exact seeded samples and
splits, batch and streaming scoring, label gating, losses, F1 and the
hierarchical information-contrast measure, all as DataFrame code.

Where things are:

* read and write annotated sets and posts: ``labelspark.sources.annotated``
  (``read_annotated``, ``read_posts``, ``write_labelled``, ``cached_or_compute``)
* labelled data: ``labelspark.plans.prepare`` (``load_processed_data``,
  ``prepare_labels``) over ``labelspark.operators.consensus``
* column functions: ``labelspark.functions.text`` (``clean_text``,
  ``normalise_id``), ``labelspark.functions.predict`` (probabilities,
  thresholds, gating, label names), ``labelspark.functions.losses``
* metrics: ``labelspark.operators.metrics`` (class weights, losses, F1, ICM)
  and ``labelspark.plans.evaluate`` (``evaluation_report``)
* samples, splits, ids: ``labelspark.operators.sampling``,
  ``labelspark.operators.posts``
* scoring: ``labelspark.streaming.scoring`` (``score``, ``stream_scoring``)
  and ``labelspark.plans.jobs`` (``scoring_job``, ``group_study``)
* training: ``labelspark.plans.train`` (``train_two_head``, ``early_stop``,
  ``best_check``, ``trial_table``)
"""

__version__ = "0.1.0"
