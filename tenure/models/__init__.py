"""Spark ML layer: scaling, stratified split / folds, cross-validated
random forest and gradient-boosted trees, model selection, importances."""
