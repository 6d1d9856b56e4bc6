"""Drug names: classification of each name and the raw spellings that mean it."""

# Fixed values. One line per drug name:
# name, class, spectrum, group, association with the outcome.
DRUG_CLASSES = [
    ("Amikacin", "Aminoglycoside", "Broad", "Aminoglycoside", "Low"),
    ("Amoxicillin", "Penicillin BS", "Broad", "Penicillin BS", "Moderate"),
    ("Amoxicillin-Clavulanate", "Penicillin BS", "Broad", "Penicillin BS", "Moderate"),
    ("Ampicillin", "Penicillin BS", "Broad", "Penicillin BS", "Moderate"),
    ("Ampicillin-Sulbactam", "Penicillin BS", "Broad", "Penicillin BS", "Moderate"),
    ("Azithromycin", "Macrolide", "Narrow", "Macrolide", "Moderate"),
    ("Aztreonam", "Monobactam", "Narrow", "Other", "High"),
    ("Bacitracin", "Polypeptide", "Narrow", "Polypeptide", "Unknown"),
    ("Bacitracin-Polymyxin", "Combination", "Broad", "Combination", "Moderate"),
    ("Cefadroxil", "Cephalosporin", "Broad", "Cephalosporin", "High"),
    ("Cefazolin", "Cephalosporin", "Broad", "Cephalosporin", "High"),
    ("Cefepime", "Cephalosporin", "Broad", "Cephalosporin", "High"),
    ("Cefpodoxime", "Cephalosporin", "Broad", "Cephalosporin", "High"),
    ("Ceftazidime", "Cephalosporin", "Broad", "Cephalosporin", "High"),
    ("Ceftriaxone", "Cephalosporin", "Broad", "Cephalosporin", "High"),
    ("Chloramphenicol", "Chloramphenicol", "Broad", "Other", "Unknown"),
    ("Ciprofloxacin", "Fluoroquinolone", "Broad", "Fluoroquinolone", "High"),
    ("Clarithromycin", "Macrolide", "Narrow", "Macrolide", "Moderate"),
    ("Clindamycin", "Lincosamide", "Narrow", "Lincosamide", "None"),
    ("Clotrimazole", "Imidazole", "Antifungal", "Antifungal", "Unknown"),
    ("Colistin", "Polypeptide", "Narrow", "Polypeptide", "Unknown"),
    ("Dapsone", "Sulfone", "Broad", "Other", "None"),
    ("Daptomycin", "Lipopeptide", "Narrow", "Other", "None"),
    ("Demeclocycline", "Tetracycline", "Broad", "Tetracycline", "Low"),
    ("Dicloxacillin", "Penicillin NS", "Narrow", "Penicillin NS", "Moderate"),
    ("Doripenem", "Carbapenem", "Broad", "Carbapenem", "High"),
    ("Doxycycline", "Tetracycline", "Broad", "Tetracycline", "Low"),
    ("Econazole", "Imidazole", "Antifungal", "Antifungal", "Unknown"),
    ("Ertapenem", "Carbapenem", "Broad", "Carbapenem", "High"),
    ("Erythromycin", "Macrolide", "Narrow", "Macrolide", "Moderate"),
    ("Ethambutol", "Ethylenediamine", "Narrow", "TB-specific", "None"),
    ("Fidaxomicin", "Macrocycle", "Narrow", "Macrocycle", "None"),
    ("Fluconazole", "Triazole", "Antifungal", "Antifungal", "Unknown"),
    ("Fosfomycin Tromethamine", "Fosfomycin", "Broad", "Other", "None"),
    ("Gatifloxacin", "Fluoroquinolone", "Broad", "Fluoroquinolone", "High"),
    ("Gentamicin", "Aminoglycoside", "Broad", "Aminoglycoside", "Low"),
    ("Imipenem-Cilastatin", "Carbapenem", "Broad", "Carbapenem", "High"),
    ("Isoniazid", "Isoniazid", "Narrow", "TB-specific", "Unknown"),
    ("Itraconazole", "Triazole", "Antifungal", "Antifungal", "Unknown"),
    ("Ketoconazole", "Imidazole", "Antifungal", "Antifungal", "Unknown"),
    ("Levofloxacin", "Fluoroquinolone", "Broad", "Fluoroquinolone", "High"),
    ("Linezolid", "Oxazolidinone", "Narrow", "Other", "None"),
    ("Meropenem", "Carbapenem", "Broad", "Carbapenem", "High"),
    ("Metronidazole", "Metronidazole", "Narrow", "Metronidazole", "Treatment"),
    ("Miconazole", "Imidazole", "Antifungal", "Antifungal", "Unknown"),
    ("Minocycline", "Tetracycline", "Broad", "Tetracycline", "Low"),
    ("Moxifloxacin", "Fluoroquinolone", "Broad", "Fluoroquinolone", "High"),
    ("Mupirocin", "Carbolic acid", "Broad", "Other", "None"),
    ("Nafcillin", "Penicillin NS", "Narrow", "Penicillin NS", "Moderate"),
    ("Neomycin", "Aminoglycoside", "Broad", "Aminoglycoside", "Low"),
    ("Neomycin-Polymyxin", "Combination", "Broad", "Combination", "Moderate"),
    ("Neomycin-Polymyxin-Bacitracin", "Combination", "Broad", "Combination", "Moderate"),
    ("Neomycin-Polymyxin-Dexameth", "Combination", "Broad", "Combination", "Moderate"),
    ("Neomycin-Polymyxin-Gramicidin", "Combination", "Broad", "Combination", "Moderate"),
    ("Nitrofurantoin", "Nitrofurantoin", "Narrow", "Other", "Low"),
    ("Ofloxacin", "Fluoroquinolone", "Broad", "Fluoroquinolone", "High"),
    ("Oxacillin", "Penicillin NS", "Narrow", "Penicillin NS", "Moderate"),
    ("Penicillin", "Penicillin NS", "Narrow", "Penicillin NS", "Moderate"),
    ("Piperacillin", "Penicillin BS", "Broad", "Penicillin BS", "Moderate"),
    ("Piperacillin-Tazobactam", "Penicillin BS", "Broad", "Penicillin BS", "Moderate"),
    ("Polymyxin B", "Polypeptide", "Narrow", "Polypeptide", "Unknown"),
    ("Posaconazole", "Triazole", "Antifungal", "Antifungal", "Unknown"),
    ("Pyrazinamide", "Pyrazinamide", "Narrow", "TB-specific", "Unknown"),
    ("Quinupristin-Dalfopristin", "Streptogramin", "Narrow", "Other", "None"),
    ("Rifabutin", "Rifamycin", "Broad", "Rifamycin", "Unknown"),
    ("Rifampin", "Rifamycin", "Broad", "Rifamycin", "Unknown"),
    ("Rifaximin", "Ansamycin", "Narrow", "Other", "None"),
    ("Streptomycin", "Aminoglycoside", "Broad", "Aminoglycoside", "Low"),
    ("Sulfacetamide", "Sulfonamide", "Broad", "Sulfonamide", "Moderate"),
    ("Sulfadiazine", "Sulfonamide", "Broad", "Sulfonamide", "Moderate"),
    ("Sulfamethoxazole", "Sulfonamide", "Broad", "Sulfonamide", "Moderate"),
    ("Sulfamethoxazole-Trimethoprim", "Combination", "Broad", "Combination", "Moderate"),
    ("Sulfasalazine", "Sulfonamide", "Broad", "Sulfonamide", "Moderate"),
    ("Telavancin", "Glycopeptide", "Narrow", "Glycopeptide", "Treatment"),
    ("Terconazole", "Triazole", "Antifungal", "Antifungal", "Unknown"),
    ("Tetracycline", "Tetracycline", "Broad", "Tetracycline", "Low"),
    ("Tigecycline", "Tetracycline", "Broad", "Tetracycline", "Low"),
    ("Tobramycin", "Aminoglycoside", "Broad", "Aminoglycoside", "Low"),
    ("Tobramycin-Dexamethasone", "Aminoglycoside", "Broad", "Aminoglycoside", "Low"),
    ("Vancomycin", "Glycopeptide", "Narrow", "Glycopeptide", "Treatment"),
    ("Voriconazole", "Triazole", "Antifungal", "Antifungal", "Unknown"),
]

# Fixed values. Raw spellings per drug name. Case and trailing blanks matter.
DRUG_SPELLINGS = {
    "Amikacin": ["Amikacin", "Amikacin Inhalation"],
    "Amoxicillin": ["AMOXicillin Oral Susp.", "Amoxicillin"],
    "Amoxicillin-Clavulanate": ["Amoxicillin-Clavulanate Susp.", "Amoxicillin-Clavulanic Acid"],
    "Ampicillin": ["Ampicillin", "Ampicillin Sodium", "NEO*IV*Ampicillin Sodium"],
    "Ampicillin-Sulbactam": ["Ampicillin-Sulbactam"],
    "Azithromycin": ["Azithromycin", "Azithromycin "],
    "Aztreonam": ["Aztreonam"],
    "Bacitracin": ["Bacitracin Ointment", "Bacitracin Ophthalmic Oint", "Bacitracin Ophthalmic oint"],
    "Bacitracin-Polymyxin": ["Bacitracin-Polymyxin Ointment", "Bacitracin/Polymyxin B Sulfate Opht. Oint"],
    "Cefadroxil": ["cefadroxil"],
    "Cefazolin": ["CefazoLIN", "Cefazolin"],
    "Cefepime": ["CefePIME", "Cefepime"],
    "Cefpodoxime": ["Cefpodo", "Cefpodoxime Proxetil"],
    "Ceftazidime": ["CeftAZIDime", "CeftazIDIME", "Ceftazidime", "CefTAZidime"],
    "Ceftriaxone": ["Ceftriaxone", "CefTRIAXone", "Ceftriaxone Sodium", "CeftriaXONE"],
    "Chloramphenicol": ["Chloramphenicol Na Succ"],
    "Ciprofloxacin": [
        "Ciprofloxacin",
        "Ciprofloxacin 0.3% Ophth Soln",
        "Ciprofloxacin HCl",
        "Ciprofloxacin IV",
        "Ciprofloxacin Ophth Soln",
        "Ciprofloxacin in D5W",
    ],
    "Clarithromycin": ["Clarithromycin"],
    "Clindamycin": ["Clindamycin", "Clindamycin HCl", "Clindamycin Phosphate", "Clindamycin Suspension"],
    "Clotrimazole": [
        "Clotrimazole",
        "Clotrimazole 1% Vaginal Cream",
        "Clotrimazole 1% Vaginal Crm",
        "Clotrimazole Cream",
    ],
    "Colistin": ["Colistin"],
    "Dapsone": ["Dapsone"],
    "Daptomycin": ["Daptomycin"],
    "Demeclocycline": ["Demeclocycline", "demeclocycline"],
    "Dicloxacillin": ["DiCLOXacillin", "Dicloxacillin"],
    "Doripenem": ["Doripenem *NF*"],
    "Doxycycline": ["Doxycycline Hyclate"],
    "Econazole": ["Econazole 1% Cream"],
    "Ertapenem": ["Ertapenem", "*NF* Ertapenem Sodium"],
    "Erythromycin": [
        "Erythromycin",
        "Erythromycin 0.5% Ophth Oint",
        "Erythromycin Ethylsuccinate",
        "Erythromycin Ethylsuccinate Suspension",
        "Erythromycin Lactobionate",
    ],
    "Ethambutol": ["Ethambutol HCl"],
    "Fidaxomicin": ["fidaxomicin"],
    "Fluconazole": ["Fluconazole"],
    "Fosfomycin Tromethamine": ["Fosfomycin Tromethamine", "fosfomycin tromethamine"],
    "Gatifloxacin": ["Gatifloxacin", "gatifloxacin"],
    "Gentamicin": [
        "Gentamicin",
        "Gentamicin 0.1% Cream",
        "Gentamicin Intraventricular",
        "Gentamicin Sulf. Ophth. Soln",
        "Gentamicin Sulfate",
        "NEO*IV*Gentamicin",
    ],
    "Imipenem-Cilastatin": ["Imipenem-Cilastatin", "Imipenem-Cilastatin *NF*"],
    "Isoniazid": ["Isoniazid"],
    "Itraconazole": ["Itraconazole"],
    "Ketoconazole": ["Ketoconazole", "Ketoconazole 2% ", "Ketoconazole Shampoo"],
    "Levofloxacin": ["LevoFLOXacin", "Levofloxacin"],
    "Linezolid": ["Linezolid", "Linezolid Suspension"],
    "Meropenem": ["Meropenem"],
    "Metronidazole": [
        "MetRONIDAZOLE",
        "MetRONIDAZOLE (FLagyl)",
        "MetronidAZOLE Topical 1 % Gel",
        "Metronidazole",
        "Metronidazole 0.75%",
        "Metronidazole Gel 0.75%-Vaginal",
        "Metronidazole Gel 0.75%-vaginal",
        "Metronidazole cream 1%",
    ],
    "Miconazole": [
        "Miconazole",
        "Miconazole 2% Cream",
        "Miconazole Nitrate (Combo Pack)",
        "Miconazole Powder 2%",
        "Miconazole Nitrate 2% Vaginal Cream",
        "Miconazole Nitrate Vag Cream 2%",
        "Miconazole Nitrate Vaginal",
    ],
    "Minocycline": ["Minocycline", "Minocycline HCl"],
    "Moxifloxacin": [
        "Moxifloxacin",
        "Moxifloxacin HCl",
        "*NF* Moxifloxacin",
        "moxifloxacin",
        "moxifloxacin ",
    ],
    "Mupirocin": ["Mupirocin", "Mupirocin Cream 2%", "Mupirocin Nasal Ointment 2%"],
    "Nafcillin": ["Nafcillin", "Nafcillin Sodium", "*NF* Nafcillin Sodium"],
    "Neomycin": ["Neomycin Sulfate"],
    "Neomycin-Polymyxin": [
        "Neomycin-Polymyxin-HC (Otic)",
        "Neomycin-Polymyxin-HC Otic Susp",
        "Neomycin/Polymyxin B Sulfate",
    ],
    "Neomycin-Polymyxin-Bacitracin": [
        "Neomycin-Polymyxin-Bacitracin",
        "Neomycin-Polymyxin-Bacitracin Ophth. Oint",
    ],
    "Neomycin-Polymyxin-Dexameth": [
        "Neomycin-Polymyxin-Dexameth Ophth. Oint",
        "Neomycin/Polymyxin/Dexameth Ophth Susp.",
    ],
    "Neomycin-Polymyxin-Gramicidin": ["Neomycin-Polymyxin-Gramicidin"],
    "Nitrofurantoin": ["Nitrofurantoin", "Nitrofurantoin (Macrodantin)", "Nitrofurantoin Monohyd (MacroBID)"],
    "Ofloxacin": ["Ofloxacin", "Ofloxacin (Ophth)"],
    "Oxacillin": ["Oxacillin"],
    "Penicillin": ["Penicillin G Benzathine", "Penicillin G Potassium", "Penicillin V Potassium"],
    "Piperacillin": ["Piperacillin", "Piperacillin Sodium"],
    "Piperacillin-Tazobactam": ["Piperacillin-Tazobactam", "Piperacillin-Tazobactam Na"],
    "Posaconazole": ["Posaconazole Suspension"],
    "Pyrazinamide": ["Pyrazinamide"],
    "Quinupristin-Dalfopristin": ["Quinupristin/Dalfopristin"],
    "Rifabutin": ["Rifabutin"],
    "Rifampin": ["Rifampin"],
    "Rifaximin": ["Rifaximin"],
    "Streptomycin": ["Streptomycin Sulfate"],
    "Sulfacetamide": ["Sulfacetamide 10% Ophth Soln.", "Sulfacetamide 10% Ophth. Oint."],
    "Sulfadiazine": ["SulfADIAzine", "Silver Sulfadiazine 1% Cream"],
    "Sulfamethoxazole": ["Sulfameth"],
    "Sulfamethoxazole-Trimethoprim": [
        "Sulfameth/Trime",
        "Sulfameth/Trimeth",
        "Sulfameth/Trimetho",
        "Sulfameth/Trimethoprim",
        "Sulfameth/Trimethoprim ",
        "Sulfameth/Trimethoprim DS",
        "Sulfamethoxazole-Trimethoprim",
        "Sulfameth/Trimethoprim SS",
        "Sulfameth/Trimethoprim Suspension",
    ],
    "Sulfasalazine": ["SulfaSALAzine", "SulfaSALAzine DR", "SulfaSALAzine_", "Sulfasalazine"],
    "Telavancin": ["Telavancin *NF*"],
    "Terconazole": ["Terconazole 0.4% Vag. Cream"],
    "Tetracycline": ["Tetracycline HCl"],
    "Tigecycline": ["Tigecycline"],
    "Tobramycin": [
        "Tobramycin",
        "Tobramycin 0.3% Ophth Ointment",
        "*NF* Tobramycin Soln",
        "Tobramycin Sulfate",
        "Tobramycin 0.3% Ophth Soln",
        "Tobramycin Fortified Ophth. Soln.",
        "Tobramycin Inhalation Soln",
        "tobramycin",
    ],
    "Tobramycin-Dexamethasone": [
        "Tobramycin-Dexamethasone Ophth Oint",
        "Tobramycin-Dexamethasone Ophth Susp",
    ],
    "Vancomycin": [
        "Vancomycin",
        "Vancomycin ",
        "Vancomycin 25mg/mL Ophth Soln",
        "Vancomycin Antibiotic Lock",
        "Vancomycin Enema",
        "Vancomycin HCl",
        "Vancomycin Intrathecal",
        "Vancomycin Oral Liquid",
        "NEO*IV*Vancomycin",
    ],
    "Voriconazole": ["Voriconazole"],
}

# Fixed value. In the prescription scope, but without a name of its own.
UNNAMED_SPELLINGS = ["Methimazole"]
