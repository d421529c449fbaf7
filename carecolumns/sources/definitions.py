"""Specifications that this package ships, in a short form.

Formulas, points and factors are fixed values of the published methods. One line is `slug | title | category | decimals | inputs | steps and outputs`. An input is
`key unit low..high {options} =default`, with any part but the key left out; `[` before or `]` after a bound would be closed anyway, `(` makes it open. A `~`
before a step's key makes it an inner step; all others are outputs. `kg*` stands for a weight that may come in kg or lbs. `?field=value` asks for an input, and
`^field=value` shows one, only where another has that value.
"""

from __future__ import annotations

import re
from functools import cache

#: Affine factors of units that an input may come in, by its base unit.
ALTERNATIVES = {"kg": {"kg": 1.0, "lbs": 0.45359237}, "cm": {"cm": 1.0, "in": 2.54}, "in": {"in": 1.0, "cm": 1 / 2.54}, "hours": {"Hours": 1.0, "Days": 24.0}}

FORMULAS = """
absolute-neutrophil-count | Absolute Neutrophil Count | Blood | 0 | wbc_count cells/microL; pmns percent 0..100; bands percent 0..100 | anc = wbc_count * (pmns + bands) / 100
acetaminophen-toxicity-assessment | Acetaminophen Toxicity Assessment | Poisoning | 1 | time_after_ingestion Hours 4..24; acetaminophen_level mcg/mL | ~later = time_after_ingestion - 4; toxlevel = exp(5.703782 - 0.175148 * later); rxlevel = toxlevel / 2; toxlevelsi = 6.62 * toxlevel
adjusted-body-weight | Adjusted Body Weight | Body measures | 0 | height in 36..90; weight kg 22..182; method_list {Devine|Robinson}; gender_list {Male|Female} | ~over = max(height, 60) - 60; ~ibw = (50 + 2.3 * over if gender_list == 'Male' else 45.5 + 2.3 * over) if method_list == 'Devine' else (52 + 1.9 * over if gender_list == 'Male' else 49 + 1.7 * over); ibw_percent = weight / ibw * 100; abw = ibw + 0.4 * (weight - ibw) if not weight < ibw else 'N/A'
aminoglycoside-clearance-estimate | Aminoglycoside Clearance Estimate | Drug levels | 2 | sex {0.85|1.0}; age yr; serum_creat mg/dL; weight kg | ag_clear = 0.6 * (sex * (140 - age) / serum_creat * weight / 72) + 10
amiodarone | Amiodarone | Doses and infusions | 1 | drug_amount mg 0..; dose mg/minute 0.16667..1; infusate_volume mL 0.. | infusion_rate = dose / (drug_amount / infusate_volume) * 60
anion-gap | Anion Gap | Salts, acids and water | 1 | na mEq/L 80..200; cl mEq/L 60..180; hco3 mEq/L | ag = na - (cl + hco3)
anion-gap-and-delta-delta-gradient | Anion Gap and Delta-Delta Gradient | Salts, acids and water | 2 | na mEq/L 80..200; cl mEq/L 60..180; hco3 mEq/L 0..30; baseline_gap mEq/L 0..50 | anion_gap = na - (cl + hco3); delta_gap = anion_gap - baseline_gap; delta_hco3 = 25 - hco3; delta_delta_gradient = delta_gap - delta_hco3
anion-gap-and-delta-delta-ratio | Anion Gap and Delta-Delta Ratio | Salts, acids and water | 2 | na mEq/L 80..200; cl mEq/L 60..180; hco3 mEq/L 0..30; baseline_gap mEq/L 0..50 | anion_gap = na - (cl + hco3); delta_gap = anion_gap - baseline_gap; delta_hco3 = 25 - hco3; delta_delta_ratio = delta_gap / delta_hco3
anion-gap-in-hypoalbumin-states | Anion Gap in Hypoalbumin States | Salts, acids and water | 2 | na mEq/L; cl mEq/L; hco3 mEq/L; normal_alb g/dL 0..20 =4.4; observed_alb g/dL 0..20 | anion_gap = na - cl - hco3; adjusted_gap = anion_gap + 2.5 * (normal_alb - observed_alb)
azithromycin-dental | Azithromycin Dental | Doses and infusions | 0 | dosage_form; dose mg/kg 10..15; weight kg* 1..200 | ~mg = 500 if weight * dose > 500 else weight * dose; output = mg; output_m_l = round(mg / dosage_form / 0.5) * 0.5
basal-energy-expenditure | Basal Energy Expenditure | Body measures | 2 | weight kg; height cm; age yr | bee_females = 655.1 + 9.563 * weight + 1.85 * height - 4.676 * age; bee_males = 66.5 + 13.75 * weight + 5.003 * height - 6.775 * age
bivalirudin | Bivalirudin | Heart | 1 | use_bolus {No|Yes}; bolus_dose mg/kg 0.1..1 ?use_bolus=Yes; infusion_dose mg/kg/hr 0.05..3; weight kg* 43..400; infusion_conc mg/mL 0.05..3 | ~mg = weight * infusion_dose; bolus_dose_output_mg = weight * bolus_dose if use_bolus == 'Yes' else 0; bolus_dose_output_ml = weight * bolus_dose / 5 if use_bolus == 'Yes' else 0; infusion_output_mg = mg; infusion_output_ml = mg / infusion_conc
body-mass-index-bmi | Body Mass Index (BMI) | Body measures | 2 | height in; weight lb | bmi = (weight / 2.205) / pow(height / 39.37, 2)
body-surface-area-bsa-gehan-and-george-method | Body Surface Area (Gehan and George) | Body measures | 2 | height cm; weight kg | bsa = 0.0235 * pow(height, 0.42246) * pow(weight, 0.51456)
body-surface-area-du-bois-method | Body Surface Area (Du Bois) | Body measures | 2 | height cm; weight kg | bsa = 0.007184 * pow(height, 0.725) * pow(weight, 0.425)
body-surface-area-mosteller-method | Body Surface Area (Mosteller) | Body measures | 2 | height cm; weight kg | bsa = sqrt(height * weight / 3600)
calcium-correction-in-hypoalbuminemia | Calcium Correction in Hypoalbuminemia | Salts, acids and water | 2 | normal_albumin {4.0|4.4}; serum_ca mg/dL; patient_albumin g/dL | ca = serum_ca + 0.8 * (normal_albumin - patient_albumin)
calcium-correction-in-hypoalbuminemia-si-units | Calcium Correction in Hypoalbuminemia (SI) | Salts, acids and water | 2 | normal_albumin {40.0|44.0}; serum_ca mmol/L; patient_albumin g/L | ca = serum_ca + 0.02 * (normal_albumin - patient_albumin)
creatinine-clearance-by-cockcroft-gault-age-16-years | Creatinine Clearance by Cockcroft-Gault (age 16 and over) | Kidney | 0 | sex {0.85|1.0}; age years 16..120; serum_creatinine mg/dL 0.3..30; weight kg* 25..250 | estimated_creatinine_clearance = sex * ((140 - age) / serum_creatinine) * (weight / 72)
creatinine-clearance-by-jelliffe | Creatinine Clearance by Jelliffe | Kidney | 1 | sex {0.9|1.0}; age yr; serum_creat mg/dL | crcl_normalized = sex * (98 - 0.8 * (age - 20)) / serum_creat
creatinine-clearance-measured | Creatinine Clearance, Measured | Kidney | 2 | urine_creat mg/dL; serum_creat mg/dL; days_urine_volume mL | creat_clear = urine_creat * days_urine_volume / serum_creat / 1440
creatinine-clearance-measured-si-units | Creatinine Clearance, Measured (SI) | Kidney | 2 | urine_creat mcmol/L; serum_creat mcmol/L; days_urine_volume mL | creat_clear = urine_creat * days_urine_volume / serum_creat / 1440
diabetes-risk-score-type-2 | Diabetes Risk Score, Type 2 | Hormones | 2 | smoker {0.0|-0.218|0.855}; fmh {0.0|0.728|0.753}; bmi {0.0|0.699|1.97|2.518}; rx_steroids {2.191|0.0}; rx_htn {1.222|0.0}; sex {-0.879|0.0}; age yr | ~log_odds = 0.063 * age + bmi + smoker + fmh + rx_htn + rx_steroids + sex - 6.322; terms = -log_odds; risk = 100 * exp(log_odds) / (1 + exp(log_odds))
digitalis-body-load | Digitalis Body Load | Drug levels | 2 | digoxin_conc ng/mL; weight kg | dbl = digoxin_conc * 5.6 * weight / 1000
dose-adjustment-for-body-surface-area | Dose Adjustment for Body Surface Area | Body measures | 2 | standard_dose mg; height cm; weight kg | bsa = 0.007184 * pow(height, 0.725) * pow(weight, 0.425); adjusted_dose = standard_dose * bsa / 1.73
dose-driven-iv-drip-rate | Dose-Driven IV Drip Rate | Doses and infusions | 2 | desired_dose mg/kg/min; weight kg; drug_in_bag mg; bag_volume mL | iv_drip_rate = 60 * desired_dose * weight * bag_volume / drug_in_bag
egfr-by-ckd-epi-creatinine-equation-egfrcr-2021-in-adults | eGFR by CKD-EPI Creatinine (2021) | Kidney | 1 | sex {1.0|2.0}; age years 18..120; serum_creatinine mg/dL 0.3..30; height cm 100..300; weight kg 20..250 | ~woman = sex == 1; ~ratio = serum_creatinine / (0.7 if woman else 0.9); ~slope = pow(ratio, -1.2) if ratio > 1 else pow(ratio, -0.241 if woman else -0.302); ~rate = 142 * slope * pow(0.9938, age) * (1.012 if woman else 1); bsa = 0.007184 * pow(height, 0.725) * pow(weight, 0.425); egfrcr = round(rate); egfrcr_for_this_bsa = round(rate * bsa / 1.73)
egfr-by-ckd-epi-cystatin-c-equation-egfrcys-2012-in-adults | eGFR by CKD-EPI Cystatin C (2012) | Kidney | 1 | sex {0.932|1.0}; age years 18..120; cystatin_c mg/L 0.4..15; height cm 100..300; weight kg 20..250 | ~ratio = cystatin_c / 0.8; ~rate = sex * 133 * pow(0.996, age) * pow(ratio, -1.328 if ratio > 1 else -0.499); bsa = 0.007184 * pow(height, 0.725) * pow(weight, 0.425); egfrcys = round(rate); egfrcys_for_this_bsa = round(rate * bsa / 1.73)
epidural-formulation-compounding | Epidural Formulation Compounding | Pain | 2 | desired_volume mL; stock_opioid_concentration mg/mL; desired_opioid_concentration mg/mL; stock_caine_percent %; desired_caine_percent % | ~opioid_share = desired_opioid_concentration / stock_opioid_concentration; ~caine_share = desired_caine_percent / stock_caine_percent; opioid_volume = opioid_share * desired_volume; caine_volume = caine_share * desired_volume; diluent_volume = (1 - opioid_share - caine_share) * desired_volume
epinephrine-weight-based | Epinephrine, Weight-Based | Doses and infusions | | drug_amount mg 0..; dose mcg/kg/min 0.01..2; weight kg* 0..200; concentration mcg/mL; infusate_volume mL 0.. | ~mg_an_hour = 0.06 * dose * weight; ~strength = drug_amount / infusate_volume if concentration == 'other' else 0.001 * concentration; infuse_rate = round(mg_an_hour / strength, 2)
eptifibatide | Eptifibatide | Heart | 1 | cr_cl mL/min 10..150; weight kg* 37..200; bolus_conc mg/mL; infusion_conc mg/mL | ~per = 60 * weight / (1000 * infusion_conc); bolus = 22.6 / bolus_conc if weight > 121 else 180 * weight / (1000 * bolus_conc); rate = (15 / infusion_conc if cr_cl >= 50 else 7.5 / infusion_conc) if weight > 121 else (per * 2 if cr_cl >= 50 else per)
fomepizole | Fomepizole | Poisoning | | weight kg* 0.. | ld = round(15 * weight * 10) / 10; first_md = round(10 * weight * 10) / 10; fifth_md = round(15 * weight * 10) / 10
fractional-excretion-of-sodium | Fractional Excretion of Sodium | Kidney | 2 | urine_na mEq/L; serum_na mEq/L; urine_cr mg/dL; serum_cr mg/dL | fe_na = (urine_na / serum_na) / (urine_cr / serum_cr) * 100
fractional-excretion-of-sodium-si-units | Fractional Excretion of Sodium (SI) | Kidney | 2 | urine_na mmol/L; serum_na mmol/L; urine_cr mcmol/L; serum_cr mcmol/L | fe_na = (urine_na / serum_na) / (urine_cr / serum_cr) * 100
fractional-excretion-of-urate | Fractional Excretion of Urate | Kidney | 2 | urine_urate mg/dL; serum_urate mg/dL; urine_cr mg/dL; serum_cr mg/dL | fe_urate = (urine_urate / serum_urate) / (urine_cr / serum_cr) * 100
gestational-age | Gestational Age | Pregnancy | 0 | crown_rump_length mm 0..100; biparietal_diameter mm; head_circumference mm 80..330; current_time epoch_ms @date; lmp_time epoch_ms @date; us_time epoch_ms @date | ~week = 7 * 24 * 3600 * 1000; ~term = 40 * week; ~by_crown = 5.2876 + crown_rump_length * (0.1584 - 0.0007 * crown_rump_length); ~by_head = exp(1.854 + head_circumference * (0.010451 + head_circumference * (0.000000043156 * head_circumference - 0.000029919))); ~by_biparietal = (44.2 + 2 * biparietal_diameter) / 7; crlweeks = by_crown; hcweeks = by_head; bpdweeks = by_biparietal; lmpweeks = (current_time - lmp_time) / week; edc_lmp = term + lmp_time; edc_crl = us_time + term - by_crown * week; edc_hc = us_time + term - by_head * week; edc_bpd = us_time + term - by_biparietal * week
glomerular-filtration-rate-by-bedside-schwartz | Glomerular Filtration Rate by Bedside Schwartz | Kidney | 1 | serum_creat mg/dL; height cm | glomerular_filtration_rate = 0.413 * height / serum_creat
glomerular-filtration-rate-by-mdrd | Glomerular Filtration Rate by MDRD | Kidney | 2 | race {1.0|1.21}; sex {0.742|1.0}; standardized_serum_creat mg/dL; age yr | glomerular_filtration_rate = 175 * pow(standardized_serum_creat, -1.154) * pow(age, -0.203) * sex * race
glomerular-filtration-rate-by-schwartz | Glomerular Filtration Rate by Schwartz | Kidney | 1 | muscle_factor {0.33|0.45|0.55|0.7}; serum_creat mg/dL; height cm | glomerular_filtration_rate = muscle_factor * height / serum_creat
henderson-hasselbach-equation | Henderson-Hasselbalch Equation | Lungs | 2 | hco3 mEq/L; paco2 mmHg | ph = 6.1 + log10(hco3 / (0.03 * paco2))
hyponatremia-correction-infusate-rate | Hyponatremia Correction Infusate Rate | Salts, acids and water | 2 | iv_na {855.0|513.0|154.0|134.0}; water_fract {0.6|0.5|0.45}; serum_na_change_per_hr mEq/L/hr 0..2 =0.25; serum_na mEq/L 0..; weight kg; iv_k mEq/L =0 | ~w = water_fract * weight + 1; infusate_rate = 1000 * serum_na_change_per_hr * w / (iv_na + iv_k - serum_na); serum_na_change_per_liter = (iv_na + iv_k - serum_na) / w
ideal-body-weight-and-dosing-weight | Ideal Body Weight and Dosing Weight | Body measures | 1 | ibw_sex {45.5|50.0}; height in 60..108; actual_weight kg 30..300 | ideal_body_weight = 2.3 * (height - 60) + ibw_sex; dosing_weight = 0.4 * (actual_weight - ideal_body_weight) + ideal_body_weight
ideal-body-weight-pediatric | Ideal Body Weight, Pediatric | Body measures | 1 | height cm* 30..152.4; ibw_unit_list {kg|lbs} | ~kg = pow(height, 2) * 1.65 / 1000; ibw = kg / 0.45359237 if ibw_unit_list != 'kg' else kg
ideal-body-weight-percentage | Ideal Body Weight Percentage | Body measures | 2 | sex {21.5|23.0}; weight kg; height m | ibw = weight * 100 / (pow(height, 2) * sex)
iv-drip-maintenance-rate | IV Drip Maintenance Rate | Doses and infusions | 2 | total_fluid_volume mL; total_admin_time hr | drip_rate = total_fluid_volume / total_admin_time
labetalol | Labetalol | Doses and infusions | 1 | id_dose mg/min 0.03..8; id_drug_amount mg | id_infusion_rate = id_dose * 15000 / id_drug_amount
lean-body-weight-female | Lean Body Weight, Female | Body measures | 2 | total_body_weight kg 47..; height cm 122..213 | ~bmi = total_body_weight / (height / 100 * (height / 100)); lbw = 9270 * total_body_weight / (8780 + 244 * bmi)
lean-body-weight-male | Lean Body Weight, Male | Body measures | 2 | total_body_weight kg 47..; height cm 137..244 | ~bmi = total_body_weight / (height / 100 * (height / 100)); lbw = 9270 * total_body_weight / (6680 + 216 * bmi)
magnesium-sulfate | Magnesium Sulfate | Doses and infusions | 1 | drug_amount g; dose g/hr 0.1..2; infusate_volume mL | ~concentration = drug_amount / infusate_volume; infuse_rate = dose * 1000 / concentration
maintenance-fluid-calculation-for-children | Maintenance Fluid for Children | Children | 1 | weight kg 3.499..200 | ~v = 100 * weight if weight < 10 else 1000 + 50 * (weight - 10) if weight < 20 else 1500 + 20 * (weight - 20); daily_volume = v; fluid_infusion_rate = daily_volume / 24
meld-score | MELD Score | Liver | 0 | hemodialysis_twice_in_week_prior {0|1} =0; creatinine mg/dL 0..4 ?hemodialysis_twice_in_week_prior=0; bilirubin mg/dL 0..200; inr ratio 0..100 | ~cr = 4.0 if hemodialysis_twice_in_week_prior == 1 else creatinine; meld_score = 10 * (0.957 * ln(cr) + 0.378 * ln(bilirubin) + 1.12 * ln(inr)) + 6.43
meld-score-si-units | MELD Score (SI) | Liver | 0 | hemodialysis_twice_in_week_prior {0|1} =0; creatinine mcmol/L 88.4..353.6 ?hemodialysis_twice_in_week_prior=0; bilirubin mcmol/L 17..; inr ratio 1..100 | ~cr = 353.6 if hemodialysis_twice_in_week_prior == 1 else creatinine; meld_score = 10 * (0.957 * ln(cr / 88.4) + 0.378 * ln(bilirubin / 17.1) + 1.12 * ln(inr)) + 6.43
meldna-score | MELD-Na Score | Liver | 0 | hemodialysis_twice_in_week_prior {0|1} =0; creatinine mg/dL 1..4 ?hemodialysis_twice_in_week_prior=0; bilirubin mg/dL 1..200; inr ratio 1..100; serum_na mEq/L 125..140 | ~cr = 4.0 if hemodialysis_twice_in_week_prior == 1 else creatinine; meld_score = 10 * (0.957 * ln(cr) + 0.378 * ln(bilirubin) + 1.12 * ln(inr)) + 6.43; meldna_score = meld_score - serum_na - 0.025 * meld_score * (140 - serum_na) + 140
meldna-score-2016 | MELD-Na Score 2016 | Liver | 0 | hemodialysis_twice_in_week_prior {0|1} =0; creatinine mg/dL ?hemodialysis_twice_in_week_prior=0; bilirubin mg/dL; inr ratio; serum_na mEq/L | ~cr = 4.0 if hemodialysis_twice_in_week_prior == 1 else creatinine; ~short_of = 137 - serum_na; meld_score = round(6.43 + 11.2 * ln(inr) + 9.57 * ln(cr) + 3.78 * ln(bilirubin)); meldna_score = meld_score + short_of * (1.32 - 0.033 * meld_score) if meld_score > 11 else meld_score
nitroprusside | Nitroprusside | Doses and infusions | | concentration mcg/mL; dose mcg/kg/minute 0.2..10; weight kg* 0..; infusate_volume mL 0..; drug_amount mg 0.. | ~mg_an_hour = 0.06 * dose * weight; ~strength = 0.001 * concentration if concentration != 'other' else drug_amount / infusate_volume; infuse_rate = round(mg_an_hour / strength, 2)
osmolal-gap | Osmolal Gap | Salts, acids and water | 2 | serum_na mEq/L 50..200; serum_glucose mg/dL 0..1500; serum_bun mg/dL 0..150; serum_ethanol mg/dL 0..2000; measured_osm mOsm/kg | ~others = serum_ethanol / 3.7 + serum_bun / 2.8 + serum_glucose / 18; calculated_osm = others + 2 * serum_na; osmolal_gap = measured_osm - calculated_osm
osmolal-gap-si-units | Osmolal Gap (SI) | Salts, acids and water | 2 | serum_na mmol/L 50..200; serum_glucose mmol/L 0..83; serum_bun mmol/L 0..54; serum_ethanol mmol/L 0..435; measured_osm mOsm/kg | ~others = 1.25 * serum_ethanol + serum_bun + serum_glucose; calculated_osm = others + 2 * serum_na; osmolal_gap = measured_osm - calculated_osm
osmolality-estimator-serum | Osmolality Estimator, Serum | Salts, acids and water | 2 | na mEq/L; glucose mg/dL; bun mg/dL | osm = na * 2 + glucose / 18 + bun / 2.8
pediatric-dosing-oral-solid | Pediatric Dosing, Oral Solid | Doses and infusions | 1 | dose mg/kg 0..; weight kg* 1..114; frequency hours* | output_dose = weight * dose; every = frequency
phenytoin-drug-level-adjusted | Phenytoin Drug Level, Adjusted | Nerves | 2 | patient_population {0.275|0.2|0.25}; phenytoin_measured mcg/mL; serum_albumin g/dL | ~d = patient_population * serum_albumin + 0.1; adjusted_free_phenytoin = phenytoin_measured / d * 0.1; adjusted_total_phenytoin = phenytoin_measured / d
qt-interval-correction-ekg | QT Interval Correction | Heart | 2 | qt_interval sec; heart_rate bpm | ~rr_interval = 60000 / heart_rate; rr_interval = 60 / heart_rate; qti_corrected = qt_interval / sqrt(rr_interval)
qt-interval-correction-ekg-multi-equation | QT Interval Correction, Several Equations | Heart | 0 | heart_rate_measure_unit_mode {0|1} =0; qt_interval millisec 100..1000; heart_rate_measure 1..500 =355 | ~heart_rate = 60000 / rr_interval if heart_rate_measure_unit_mode == 1 else heart_rate_measure; ~rr_interval = heart_rate_measure if heart_rate_measure_unit_mode == 1 else 60000 / heart_rate; qt_interval_corrected_bazett = qt_interval / sqrt(rr_interval / 1000); qt_interval_corrected_fridericia = qt_interval / pow(rr_interval / 1000, 1 / 3); qt_interval_corrected_framingham = qt_interval + 0.154 * (1000 - rr_interval); qt_interval_corrected_hodges = qt_interval + 1.75 * (heart_rate - 60)
single-dose-volume-conversion | Single Dose Volume Conversion | Doses and infusions | 3 | dose 0..; drug_amount 0..; per mL 0.. | dose_in_m_l = dose * (per / drug_amount)
sodium-correction-in-hyperglycemia | Sodium Correction in Hyperglycemia | Salts, acids and water | 1 | measured_sodium mEq/L; glucose mg/dL | corrected_sodium = measured_sodium + 0.024 * (glucose - 100)
sodium-deficit-in-hyponatremia | Sodium Deficit in Hyponatremia | Salts, acids and water | 2 | sex {0.5|0.6}; normal_wgt kg; serum_na mEq/L; desired_na mEq/L =140 | na_deficit = sex * normal_wgt * (desired_na - serum_na)
transtubular-potassium-gradient | Transtubular Potassium Gradient | Kidney | 2 | urine_k mEq/L; serum_k mEq/L; urine_osm mOsm/kg; serum_osm mOsm/kg | ttkg = (urine_k / serum_k) / (urine_osm / serum_osm)
urinary-protein-excretion-estimation | Urinary Protein Excretion Estimation | Kidney | 2 | spot_urine_protein mg/dL; spot_urine_creat mg/dL | protein_excreted = spot_urine_protein / spot_urine_creat
valganciclovir | Valganciclovir | Children | 0 | form; height cm 15..229; weight kg 2.5..100; sr_cr mg/dL (0..; id_gender {MALE|FEMALE}; id_k_age_m {0.33|0.45|0.55|0.7} ^id_gender=MALE; id_k_age_f {0.33|0.45|0.55} ^id_gender=FEMALE | ~surface = sqrt(weight * height / 3600); ~clearance = min(150, (id_k_age_m if id_gender == 'MALE' else id_k_age_f) * height / sr_cr); ~mg = 7 * clearance * surface; ~solution = 900 if mg > 900 else round(mg / 10) * 10 if mg >= 20 else round(mg / 5) * 5; ~tablets = 450 if 405 <= mg <= 495 else 900 if mg >= 810 else ''; output_dose_mg = tablets if form <= 1 else '' if mg < 5 else solution; output_dose_ml = output_dose_mg / 50 if form > 1 else 0
milrinone | Milrinone | Doses and infusions | | concentration mcg/mL 100..800; drug_amount mg 0..; infusate_volume mL 0..; weight kg* 0..; dose mcg/kg/minute 0.0625..1 | ~mg_an_hour = 0.06 * dose * weight; ~strength = drug_amount / infusate_volume if concentration == 'other' else 0.001 * concentration; infuse_rate = round(mg_an_hour / strength, 2)
vecuronium | Vecuronium | Doses and infusions | | concentration mg/mL; drug_amount mg 0..; dose mcg/kg/minute 0.5..3; weight kg* 0..; infusate_volume mL 0.. | ~mg_an_hour = 0.06 * dose * weight; ~strength = concentration if concentration != 'other' else drug_amount / infusate_volume; infuse_rate = round(mg_an_hour / strength, 2)
water-deficit-in-hypernatremia | Water Deficit in Hypernatremia | Salts, acids and water | 2 | age_sex_factor {0.6|0.5|0.45}; desired_na mEq/L =140; normal_weight kg; serum_na mEq/L | ~excess = serum_na / desired_na - 1; wdef = excess * age_sex_factor * normal_weight
weight-based-dosage | Weight-Based Dosage | Doses and infusions | 2 | dosage mg/kg; weight kg; med_amount mg; per_volume mL | dose = weight * dosage; liquid_dose = dose * per_volume / med_amount
"""

#: One more column: first dose, last dose and step of the table. `~value` is the row's own formula.
TITRATIONS = """
atracurium | Atracurium | Doses and infusions | | drug_amount mg; dose mcg/kg/min 2..40; weight kg* 0..200; infusate_volume mL (0.. | ~concentration = drug_amount / infusate_volume; ~rate = dose * weight / concentration * 60 / 1000; infuse_rate = round(rate, 2) | 2..20/1
cisatracurium | Cisatracurium | Doses and infusions | | drug_amount mg; dose mcg/kg/min 0.5..10; weight kg* 1..200; infusate_volume mL (0.. | ~concentration = drug_amount / infusate_volume; ~value = dose * weight / concentration * 60 / 1000; infuse_rate = round(value, 1) | 0.5..10/0.5
diltiazem | Diltiazem | Doses and infusions | | dose mg/hr 5..15; concentration {0.45454545454545453|0.8333333333333334} | ~value = dose / concentration; rate = round(value, 1) | 5..15/1
dobutamine | Dobutamine | Doses and infusions | | concentration mcg/mL; drug_amount mg 0..; dose mcg/kg/min 0.5..20; weight kg* 0..200; infusate_volume mL 0.. | ~strength = drug_amount / infusate_volume if concentration == 'other' else 0.001 * concentration; ~value = 0.06 * dose * weight / strength; infuse_rate = round(value, 2) | 1..20/1
dopamine | Dopamine | Doses and infusions | | concentration mcg/mL; drug_amount mg 0..; dose mcg/kg/min 0.5..50; weight kg* 0..200; infusate_volume mL 0.. | ~strength = drug_amount / infusate_volume if concentration == 'other' else 0.001 * concentration; ~rate = 0.06 * dose * weight / strength; infuse_rate = round(rate, 2) | 1..50/1
epinephrine | Epinephrine | Doses and infusions | | drug_amount mg; dose mcg/min 1..20; infusate_volume mL | ~concentration = drug_amount / infusate_volume * 1000; infuse_rate = round(dose / concentration * 60, 1) | 1..20/0.5
heparin-maintenance-infusion | Heparin Maintenance Infusion | Doses and infusions | | dose units/hr 100..2000; concentration units/mL | rate = round(dose / concentration, 1) | 100..1600/50
lidocaine | Lidocaine | Doses and infusions | | drug_amount mg; dose mg/min 0.5..4; infusate_volume mL | ~value = dose / (drug_amount / infusate_volume) * 60; infuse_rate = round(value, 1) | 0.5..4/0.5
norepinephrine | Norepinephrine | Doses and infusions | | drug_amount mg; dose mcg/min 0.5..60; infusate_volume mL (0.. | ~value = dose / (drug_amount * 1000 / infusate_volume) * 60; infuse_rate = round(value, 1) | 0.5..32.5/1
phenylephrine | Phenylephrine | Doses and infusions | | drug_amount mg; dose mcg/min 1..360; infusate_volume mL | ~concentration = drug_amount / infusate_volume; infuse_rate = round(dose / concentration * 60 / 1000, 1) | 10..360/10
procainamide | Procainamide | Doses and infusions | 1 | drug_amount mg; dose mg/min 1..6; infusate_volume mL | ~value = dose / (drug_amount / infusate_volume) * 60; infuse_rate = round(value, 1) | 1..6/0.5
propofol | Propofol | Doses and infusions | | dose mcg/kg/minute 5..300; weight kg* 3..; concentration mg/mL | ~value = dose * weight * 60 / (1000 * concentration); infuse_rate = round(value, 2) | 5..300/5
"""

#: Groups are `name: points of the options`, bands `low..high label` in order; the first that holds counts. A `+` before a group's name makes it a multiple choice.
SCORES = """
4t-score | 4T Score | Blood | thrombocytopenia: 2,1,0; timing: 2,1,0; thrombosis: 2,1,0; other causes: 2,1,0 | 0..3 Low probability; 4..5 Intermediate probability; 6..8 High probability
apgar-score | Apgar Score | Children | heart rate: 2,1,0; breathing: 2,1,0; tone: 2,1,0; color: 2,1,0; reflex: 2,1,0 | 7..10 Normal; 0..6 Distress
cha2ds2-vasc-score | CHA2DS2-VASc Score | Heart | +clinical features: 1,1,1,2,1; age: 1,2; sex: 1,0 | 0..0 0% per year; 1..1 1.3% per year; 2..2 2.2% per year; 3..3 3.2% per year; 4..4 4% per year; 5..5 6.7% per year; 6..6 9.8% per year; 7..7 9.6% per year; 8..8 6.7% per year; 9..9 15.2% per year
chads2-score | CHADS2 Score | Heart | +findings: 1,1,1,1,2 | 0..0 1.9% per year; 1..1 2.8% per year; 2..2 4% per year; 3..3 5.9% per year; 4..4 8.5% per year; 5..5 12.5% per year; 6..6 18.2% per year
has-bled-bleeding-risk-score | HAS-BLED Bleeding Risk | Heart | +findings: 1,1,1,1,1,1,1,1,1 | 0..2 Low to moderate risk; 3..9 High risk
timi-risk-score-ua-nstemi | TIMI Risk Score for UA and NSTEMI | Heart | +findings: 1,1,1,1,1,1,1 | 0..1 5%; 2..2 8%; 3..3 13%; 4..4 20%; 5..5 26%; 6..7 41%
child-pugh-classification | Child-Pugh Classification | Liver | encephalopathy: 1,2,2,3,3; ascites: 1,2,3; bilirubin: 1,2,3; albumin: 1,2,3; prothrombin: 1,2,3 | 5..6 Child class A; 7..9 Child class B; 10..15 Child class C
glasgow-coma-scale | Glasgow Coma Scale | Nerves | eye opening: 4,3,2,1; motor response: 6,5,4,3,2,1; verbal response: 5,4,3,3,2,1 | 15..15 Normal; 3..14 Abnormal
modified-wells-score-for-dvt | Modified Wells Score for DVT | Blood | +criteria: 1,1,1,1,1,1,1,1,-2,1 | 2..9 DVT likely; -2..1 DVT unlikely
pharyngitis-evaluation-and-treatment-criteria | Pharyngitis Criteria | Infections | temperature: 1,0; cough: 0,1; nodes: 1,0; tonsils: 1,0; age: 1,0,-1 | 0..0 2-3%; 1..1 4-6%; 2..2 10-12%; 3..3 27-28%; 4..5 38-63%
pulmonary-embolism-wells-score | Pulmonary Embolism Wells Score | Lungs | criteria: 3,3,1.5,1.5,1.5,1,1 | 6.. High probability; 2..6 Moderate probability; ..2 Low probability
sofa-score | SOFA Score | Intensive care | lung: 0,1,2,3,4; platelets: 0,1,2,3,4; liver: 0,1,2,3,4; pressure: 0,1,2,3,4; coma: 0,1,2,3,4; kidney: 0,1,2,3,4 |
timi-risk-score-stemi | TIMI Risk Score for STEMI | Heart | +findings: 1,3,2,2,1,1,1; age: 3,2,0 | 0..0 0.8%; 1..1 1.6%; 2..2 2.2%; 3..3 4.4%; 4..4 7.3%; 5..5 12%; 6..6 16%; 7..7 23%; 8..8 27%; 9..14 36%
"""

#: Pairs are `from > to x factor + offset`.
CONVERTERS = """
unit-conversions-length | Unit Conversions: Length | in > cm x 2.54; ft > m x 0.3048; yd > m x 0.9144; mile > km x 1.609344
unit-conversions-temperature | Unit Conversions: Temperature | Celsius > Fahrenheit x 1.8 + 32; Celsius > Kelvin x 1 + 273.15; Fahrenheit > Kelvin x 0.5555555556 + 255.372222
unit-conversions-time | Unit Conversions: Time | minute > second x 60; hour > minute x 60; day > hour x 24; week > day x 7
unit-conversions-volume | Unit Conversions: Volume | gallon > L x 3.785412; quart > L x 0.9463529; cup > L x 0.236588236; fl oz > L x 0.02957353; tablespoon > L x 0.0147867648; teaspoon > L x 0.0049289217; mL > L x 0.001
unit-conversions-weight | Unit Conversions: Weight | kg > lb x 2.20462262; lb > oz x 16; g > kg x 0.001
si-unit-conversions-coagulation-tests | SI Unit Conversions: Coagulation | Fibrinogen mg/dL > Fibrinogen g/L x 0.01; D-dimer mcg/mL > D-dimer nmol/L x 5.476
si-unit-conversions-drugs | SI Unit Conversions: Drugs | Digoxin ng/mL > Digoxin nmol/L x 1.281; Phenytoin mcg/mL > Phenytoin umol/L x 3.964; Vancomycin mcg/mL > Vancomycin umol/L x 0.69; Lithium mEq/L > Lithium mmol/L x 1; Theophylline mcg/mL > Theophylline umol/L x 5.55; Salicylate mg/dL > Salicylate mmol/L x 0.0724; Ethanol mg/dL > Ethanol mmol/L x 0.2171
si-unit-conversions-hematology | SI Unit Conversions: Hematology | Hemoglobin g/dL > Hemoglobin g/L x 10; Hematocrit % > Hematocrit 1 x 0.01; RBC 10^6/uL > RBC 10^12/L x 1; WBC 10^3/uL > WBC 10^9/L x 1; Platelets 10^3/uL > Platelets 10^9/L x 1; Ferritin ng/mL > Ferritin ug/L x 1
thyroid-medication-dosing-conversions | Thyroid Medication Conversions | Desiccated Thyroid mg > Levothyroxine mcg x 1.6667
"""

TREE = {
    "slug": "rabies-post-exposure-prophylaxis-treecalc", "title": "Rabies Post-Exposure Prophylaxis", "category": "Infections", "renderer": "tree",
    "tables": {
        "nodes": {"q1": {"q": "Contact with saliva or brain tissue, or exposure to a bat?", "yes": "q2", "no": "none"}, "q2": {"q": "Wild animal?", "yes": "q3", "no": "q2b"}, "q2b": {"q": "Healthy dog, cat or ferret that can be watched for 10 days?", "yes": "observe", "no": "give_domestic"}, "q3": {"q": "Brain available for testing?", "yes": "q4", "no": "give_untested"}, "q4": {"q": "Antibody test positive?", "yes": "give_tested", "no": "none_tested"}},
        "outcomes": {"none": {"tone": "good"}, "observe": {"tone": "good"}, "give_domestic": {"tone": "bad"}, "give_untested": {"tone": "bad"}, "give_tested": {"tone": "bad"}, "none_tested": {"tone": "good"}},
    },
}


def _number(s: str) -> float | None:
    return float(s) if s.strip() else None


def _input(part: str) -> dict:
    words, out = part.split(), {"required": True, "default": None, "constraints": {}}
    out["key"] = out["label"] = words[0]
    for w in words[1:]:
        if w[0] == "{":
            values = [float(v) if re.fullmatch(r"-?[\d.]+", v) else v for v in w[1:-1].split("|")]
            out["options"] = [{"label": str(v), "value": v, "key": f"opt_{i}"} for i, v in enumerate(values)]
        elif ".." in w and re.match(r"[(\d.-]", w):
            low, high = w.lstrip("(").split("..")
            out["constraints"] = {k: float(v) for k, v in (("exclusive_min" if w[0] == "(" else "min", low), ("max", high)) if v}
        elif w[0] == "=":
            out["default"], out["required"] = float(w[1:]), False
        elif w[0] in "?^":
            field, value = w[1:].split("=")
            out |= {"required": False, "required_when": {"field": field, "equals": [value]}} if w[0] == "?" else {"visible_when": {"field": field, "equals": [value]}}
        elif w == "@date":
            out["widget"], out["required"] = "date", True
        else:
            out["base_unit"] = out["display_unit"] = w.rstrip("*")
            if w[-1] == "*":
                out["units"] = [{"code": c, "label": c, "factor": f, "offset": 0.0} for c, f in ALTERNATIVES[out["base_unit"]].items()]
    return out


def _expressions(part: str) -> dict:
    steps, outputs = [], []
    for line in part.split(";"):
        key, source = (x.strip() for x in line.split("=", 1))
        (steps if key[0] == "~" else outputs).append({"key": key.lstrip("~"), "expr": source} | ({} if key[0] == "~" else {"label": key, "decimals": None}))
    return {"steps": steps, "outputs": outputs}


@cache
def specifications() -> dict[str, dict]:
    """slug -> specification, in the same form as a JSON document of a catalogue folder."""
    out = {}
    for source, renderer in ((FORMULAS, "formula"), (TITRATIONS, "titration_table")):
        for line in source.strip().splitlines():
            slug, title, category, decimals, inputs, expressions, *ladder = (p.strip() for p in re.split(r" \|(?= |$)", line))
            spec = {"slug": slug, "title": title, "category": category, "renderer": renderer, "display": {"decimal_precision": int(decimals) if decimals else None}, "inputs": [_input(p) for p in inputs.split(";")], "compute": _expressions(expressions)}
            if ladder:
                low, high, step = (float(x) for x in re.split(r"\.\.|/", ladder[0]))
                spec["compute"]["row_variable"] = "dose"
                spec["tables"] = {"dose_ladder": {"values": [low + k * step for k in range(round((high - low) / step) + 1)]}}
            out[slug] = spec
    for line in SCORES.strip().splitlines():
        slug, title, category, groups, bands = (p.strip() for p in re.split(r" \|(?= |$)", line))
        found = []
        for k, g in enumerate(groups.split(";")):
            name, points = g.split(":")
            name = name.strip()
            found.append({"key": name.lstrip("+"), "label": name.lstrip("+"), "selection": "multiple" if name[0] == "+" else "single", "required": name[0] != "+", "options": [{"key": f"opt_{k}_{i}", "label": f"option {i + 1}", "points": float(p)} for i, p in enumerate(points.split(","))]})
        split = [re.fullmatch(r"\s*(-?[\d.]*?)\.\.(-?[\d.]*) (.+?)\s*", b) for b in bands.split(";") if b.strip()]
        out[slug] = {"slug": slug, "title": title, "category": category, "renderer": "score", "scoring": {"groups": found, "bands": [{"min": _number(m[1]), "max": _number(m[2]), "label": m[3]} for m in split]}}
    for line in CONVERTERS.strip().splitlines():
        slug, title, pairs = (p.strip() for p in line.split(" | "))
        found = [re.fullmatch(r"\s*(.+?) > (.+?) x ([\d.]+)(?: \+ ([\d.]+))?\s*", p) for p in pairs.split(";")]
        out[slug] = {"slug": slug, "title": title, "category": "Unit Conversions", "renderer": "convert", "tables": {"pairs": [{"from": m[1], "to": m[2], "factor": float(m[3]), "offset": float(m[4] or 0)} for m in found]}}
    out[TREE["slug"]] = TREE
    return out
