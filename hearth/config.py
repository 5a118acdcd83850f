"""Default parameters for the case-file flows.

Everything here is a plain value that an operator takes as a parameter; the
flows in :mod:`hearth.plans.flows` pass these defaults, a caller can
pass others.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES that must equal the source's for identical results
# (column names of the case file, code maps, limits). Kept in natural order.
# ---------------------------------------------------------------------------

# Budget amounts of a case, in the order the source lists them (46).
BUDGET_COLUMNS = [
    "revenus", "allocations", "pensions_alim", "revenus_FL", "autre1", "autre2", "autre3",
    "loyer", "charges_loc_cop", "gdf", "electicite", "eau", "tel_fixe", "tel_port", "impots",
    "taxe_fonciere", "taxe_habitation", "assurance_habitat", "assurance_voiture", "mutuelle",
    "autre_assurance", "epargne_enfant", "frais_scolarite", "transport_enfant",
    "autres_charges_enfant", "frais_bancaire", "soins_recurrent", "frais_justice",
    "frais_transport", "epargne", "autres_charges", "fioul_bois", "internet", "abonnement_tv",
    "abonnement_autre", "autre_charge", "taxe_ordure", "autre_impots", "assurance_gav",
    "assurance_prevoyance", "assurance_scolaire", "pensions_alim_payee", "internat",
    "frais_garde", "cantine", "alim_hyg_hab",
]

# Case descriptors kept in the clean dataset.
OTHER_COLUMNS = [
    "id", "age", "profession", "logement", "situation", "retard_facture", "retard_pret",
    "orientation", "personne_charges", "id_user",
]

# Case columns of the wide extract, around the platform and the age (30).
CASE_COLUMNS = [
    "id", "etat", "id_group", "id_user", "charte", "duree", "profession", "logement",
    "situation", "transferable", "retard_facture", "retard_pret", "nature", "orientation",
    "personne_charges", "vip", "indicateur_suivi", "releve_bancaire", "aide_sociale",
    "reactive", "memo", "etat_old", "orientation_old", "indicateur_suivi_old", "transfert",
    "plan_bdf", "effacement_dette", "gain_mediation", "PCB", "mensu_bdf",
]

# Income amounts (7) summed into revenus_tot.
INCOME_COLUMNS = [
    "revenus", "allocations", "pensions_alim", "revenus_FL", "autre1", "autre2", "autre3",
]

# Charge amounts as listed (38) summed into charges.
CHARGE_COLUMNS = [
    "loyer", "charges_loc_cop", "gdf", "electicite", "eau", "tel_fixe", "tel_port", "impots",
    "taxe_fonciere", "taxe_habitation", "assurance_habitat", "assurance_voiture", "mutuelle",
    "autre_assurance", "epargne_enfant", "frais_scolarite", "transport_enfant",
    "autres_charges_enfant", "frais_bancaire", "soins_recurrent", "frais_justice",
    "frais_transport", "epargne", "autres_charges", "fioul_bois", "internet", "abonnement_tv",
    "abonnement_autre", "autre_charge", "taxe_ordure", "autre_impots", "assurance_gav",
    "assurance_prevoyance", "assurance_scolaire", "pensions_alim_payee", "internat",
    "frais_garde", "cantine",
]
# The source, as it ran, lost both phone columns to a missing comma (36 columns).
CHARGE_COLUMNS_AS_RUN = [c for c in CHARGE_COLUMNS if c not in ("tel_fixe", "tel_port")]

# Credit measures spread per credit type, and the credit types spread.
CREDIT_MEASURES = ["sum_mensualite", "moy_nb_mensualite", "sum_solde"]
CREDIT_TYPES = [0, 1, 2, 3, 4, 5]
# Credit detail kept in the clean dataset (instalments and balances per type).
CREDIT_DETAIL = [f"{m}_{t}" for m in ("sum_mensualite", "sum_solde") for t in CREDIT_TYPES]
CREDIT_TOTALS = ["sum_mensualite", "sum_solde"]

# Budget type excluded before picking the latest budget.
EXCLUDED_BUDGET_TYPE = "Impaye"

# Old orientation label -> orientation code (default 0).
ORIENTATION_CODES = {
    "surendettement": 4,
    "accompagnement": 2,
    "mediation": 3,
    "microcredit": 5,
    "Microcredit": 5,
}
# Orientation code -> name.
ORIENTATION_NAMES = {2: "Accompagnement", 3: "Mediation", 4: "Surendettement"}

# Situations counted as couples for consumption units; the housing label of tenants.
COUPLE_SITUATIONS = ["concubinage", "marie", "pacs"]
TENANT_LABEL = "locataire"
# Category strings merged into the label 'None' before encoding.
NONE_LABELS = ["0", "nan"]

# Consumption units: first adult, couple, per dependant.
UNITS_SINGLE, UNITS_COUPLE, UNITS_PER_DEPENDANT = 1.0, 1.5, 0.3

# Plausibility limits.
INSTALMENT_MAX = 80000      # 0 < sum_mensualite <= 80000
AGE_RANGE = (18, 90)        # inclusive
DEPENDANTS_RANGE = (0, 10)  # inclusive
FLOOR_AMOUNT = 400          # charges > 400 and revenus_tot > 400
ORIENTATION_KEPT = (1, 5)   # exclusive bounds: keeps 2, 3, 4

# Columns re-imputed by nearest neighbours, and neighbours used.
SPARSE_COLUMNS = [
    "sum_mensualite", "age", "personne_charges", "loyer", "gdf", "electicite", "eau",
    "assurance_habitat", "charges", "revenus_tot",
]
IMPUTE_NEIGHBOURS = 3
# Columns nulled for tenants when zero.
TENANT_ZERO_COLUMNS = ["loyer", "assurance_habitat"]

# Threshold rule: classes, three-class ratio band, adviser floor and merged id.
CLASS_ABOVE, CLASS_MIDDLE, CLASS_BELOW = 2, 3, 4
RATIO_BAND = (1 / 23, 1 / 17)
ADVISER_FLOOR, MERGED_ADVISER = 20, 10000
MISSING_ADVISER = 0

# Histogram of the disposable income.
HIST_BINS, HIST_RANGE = 30, (-1000.0, 2000.0)

# Cross-validation and chosen models.
N_FOLDS, FOLD_SEED, HOLDOUT_SEED, HOLDOUT_TEST_FRACTION = 5, 1, 10, 0.25
RF_PARAMS = {"numTrees": 120, "maxDepth": 10}
GBT_PARAMS = {"rounds": 58, "eta": 0.2, "depth": 4, "min_child_weight": 4, "subsample": 0.9, "gamma": 0.3}
KNN_PARAMS = {"k": 125, "weights": "distance", "p": 1}
SVM_PARAMS = {"C": 1.0, "gamma": 0.01}
SVM_GRID = {"C": [0.5, 1, 2], "gamma": [0.005, 0.01, 0.02, 0.05]}
RF_GRID = {"numTrees": [50, 70, 100, 120, 150], "maxDepth": [3, 5, 7, 10, 15]}
# (the source's column share has no effect there: its name is misspelt)
GBT_GRID = {"rounds": list(range(10, 60, 2)), "eta": [0.2], "depth": [4], "min_child_weight": [4],
            "subsample": [0.8, 0.9, 1.0], "gamma": [0.0, 0.001, 0.005, 0.01]}
KNN_GRID = {"k": [50, 75, 100, 125, 150, 200], "weights": ["uniform", "distance"], "p": [1, 2, 3]}

# PCA reduction keeps components whose cumulative ratio is below this.
PCA_VARIANCE_KEPT = 2 / 3

# Clustering: micro-clusters, Ward cut height, small-cluster floor and id.
MICRO_CLUSTERS, MICRO_SEED = 1000, 0
WARD_CUT = 85.0
SMALL_CLUSTER_FLOOR, SMALL_CLUSTER_ID = 30, 0
VTEST_LIMIT = 1.96
