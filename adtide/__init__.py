"""Ad-performance analytics as Spark DataFrame jobs.

Every public function takes DataFrames (plus plain parameters) and returns a
lazy DataFrame; nothing is collected to the driver.

* ``adtide.sources``   – reading, cleaning and writing tables
* ``adtide.functions`` – column expressions and the exact distributed quantile
* ``adtide.operators`` – roll-ups, trends, rankings, thresholds, drift, quality,
  insight evaluation, alerts
* ``adtide.plans``     – task dispatch and the end-to-end analysis
"""
