from evengap.plans.tables import (bus_subset, enrich_events, extra_features, headways, model_dataset,
                                  sequence_dataset, sequence_statistics, standardize_sequence, trip_features)

__all__ = ["bus_subset", "enrich_events", "extra_features", "headways", "model_dataset", "sequence_dataset",
           "sequence_statistics", "standardize_sequence", "trip_features"]
