"""Fitting and selecting predictors with Spark ML. Rows stay on the cluster; only parameters come to the driver."""
