"""paravane: a PySpark-native analytics engine for controlled text-perturbation studies."""
